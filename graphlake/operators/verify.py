"""Checks of stored graphs against their own metadata: counts, chunks, offsets, order and ends.

A task gives facts of what it reads: of a vertex chunk its rows and a bitmap of their ids, of an edge chunk its rows and
bounds, of a vertex where its edges begin and end in its part. Only these are shuffled.
Edges need no sort: they are in order if and only if those of each vertex stand exactly where its offsets say.

Faults come as rows: what, type, part, chunk, found, expected. `part` is the vertex chunk, also of vertex tables; the
driver reads count files only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from ..functions import scalars
from ..plans.info import PropertyGroup
from ..sources.reader import KEYS, EdgeReader, VertexReader
from . import layout as lay

V, S, D = names.VERTEX, names.SRC, names.DST
SCHEMA = "what string, type string, part long, chunk long, found long, expected long"
_N, _BEGIN, _END = map(names.hidden, ("n", "begin", "end"))


def _faults(df: DataFrame, what: str, kind: str, part: Column | None, chunk: Column | None, found: Column, expected: Column) -> DataFrame:
    """Rows of facts whose found value isn't the expected one; a null on one side is a fault too."""
    none = F.lit(None).cast("long")
    rows = df.select(F.lit(what).alias("what"), F.lit(kind).alias("type"), (none if part is None else part).cast("long").alias("part"), (none if chunk is None else chunk).cast("long").alias("chunk"), found.cast("long").alias("found"), expected.cast("long").alias("expected"))
    return rows.filter(~F.col("found").eqNullSafe(F.col("expected")))


def vertex_faults(reader: VertexReader) -> DataFrame:
    """Of a vertex type, for each chunk of each group and of the labels: `vertex_rows`, `vertex_first`, `vertex_last` (its
    smallest and largest id) and `vertex_repeats` (distinct ids, counted by bitmaps, beside rows): together, its ids are dense.
    """
    info, spark, n = reader.info, reader.spark, reader.count()
    first = F.col("part") * info.chunk_size
    chunks = spark.range(lay.chunks(n, info.chunk_size)).withColumnRenamed("id", "part").withColumn("there", F.lit(True))
    rows = F.least(F.lit(info.chunk_size), F.lit(n) - first)
    tables = [(g.prefix, reader.placed_ids(g)) for g in info.groups]
    if info.labels and reader.files.exists(reader.prefix + info.labels_path()):
        tables.append(("labels/", reader.placed_ids(None)))
    out = []
    for what, ids in tables:
        held = ids.groupBy("part", F.bitmap_bucket_number(V).alias("bucket")).agg(
            F.count("*").alias("n"), F.min(V).alias("low"), F.max(V).alias("high"), F.bitmap_construct_agg(F.bitmap_bit_position(V)).alias("bits")
        )
        facts = held.groupBy("part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.bitmap_count("bits")).alias("ids"))
        both, kind, p = facts.join(chunks, "part", "full"), f"{info.type}:{what}", F.col("part")
        out.append(_faults(both, "vertex_rows", kind, p, None, F.coalesce("n", F.lit(0)), F.when(F.col("there"), rows).otherwise(0)))
        known = both.filter("there and n is not null")
        out.append(_faults(known, "vertex_first", kind, p, None, F.col("low"), first))
        out.append(_faults(known, "vertex_last", kind, p, None, F.col("high"), first + rows - 1))
        out.append(_faults(known, "vertex_repeats", kind, p, None, F.col("ids"), F.col("n")))
    return reduce(DataFrame.unionByName, out)


def edge_faults(reader: EdgeReader, src_count: int, dst_count: int) -> DataFrame:
    """Of an edge type in one layout:

    `edge_end`: edges of a chunk with an end that is null or no vertex; `edge_part`: edges in a part that isn't their
    aligned end's; `chunk_rows`: a chunk that isn't full, though others follow, or is too full; `chunk_numbers`: how many
    chunks a part has; `group_rows`: rows of a group's chunk, beside those of the adjacency list; `edge_count`: the count file of a part; `vertex_count`: that of
    the layout; and of ordered layouts `offset_rows`, `offset_first`, `offset_last`, `offset_falls` of a part's offset
    table, `edges_begin`, `edges_end` and `edges_apart`: where a vertex's edges stand, by rows and by offsets, and that no
    others stand between them, with the vertex's place in `chunk`.
    """
    info, spark, kind = reader.info, reader.spark, f"{reader.info.concat()}:{reader.layout.value}"
    main, size, parts = lay.ends(reader.layout)[0], info.chunk_size, reader.part_count()
    part, chunk, row = map(F.col, KEYS)
    rows = reader.adj_rows()
    bad = lambda end, n: F.col(end).isNull() | (F.col(end) < 0) | (F.col(end) >= n)
    facts = rows.groupBy(part.alias("part"), chunk.alias("chunk")).agg(
        F.count("*").alias("n"), F.count_if(bad(S, src_count) | bad(D, dst_count)).alias("ends"), F.count_if(~scalars.chunk_of(F.col(main), reader.part_size).eqNullSafe(part)).alias("strays")
    )
    facts = facts.join(facts.groupBy("part").agg(F.max("chunk").alias("last"), F.sum("n").alias("held")), "part")
    p, c = F.col("part"), F.col("chunk")
    out = [
        _faults(facts, "edge_end", kind, p, c, F.col("ends"), F.lit(0)),
        _faults(facts, "edge_part", kind, p, c, F.col("strays"), F.lit(0)),
        _faults(facts, "chunk_rows", kind, p, c, F.col("n"), F.when(c < F.col("last"), F.lit(size)).otherwise(F.least(F.col("n"), F.lit(size)))),
    ]
    per_part = spark.range(parts).withColumnRenamed("id", "part").join(facts.select("part", "held", "last").distinct(), "part", "left").select("part", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("last", F.lit(-1)).alias("last"))
    out.append(_faults(per_part, "chunk_numbers", kind, p, None, F.col("last") + 1, F.ceil(F.col("held") / size)))
    stored = spark.createDataFrame([(k, reader.count(k)) for k in range(parts)], "part long, stored long")
    out.append(_faults(stored.join(per_part, "part"), "edge_count", kind, p, None, F.col("stored"), F.col("held")))
    counts = spark.createDataFrame([(reader.vertex_count(), src_count if reader.layout.by_source else dst_count)], "a long, b long")
    out.append(_faults(counts, "vertex_count", kind, None, None, F.col("a"), F.col("b")))
    out += [_group_faults(reader, g, facts, kind) for g in info.groups]
    return reduce(DataFrame.unionByName, out + (_offset_faults(reader, rows, per_part, kind) if reader.layout.ordered else []))


def _group_faults(reader: EdgeReader, group: PropertyGroup, facts: DataFrame, kind: str) -> DataFrame:
    own = reader.group_rows(group, columns=[]).groupBy(F.col(KEYS[0]).alias("part"), F.col(KEYS[1]).alias("chunk")).agg(F.count("*").alias("own"))
    return _faults(facts.select("part", "chunk", "n").join(own, ["part", "chunk"], "full"), "group_rows", f"{kind}:{group.prefix}", F.col("part"), F.col("chunk"), F.coalesce("own", F.lit(0)), F.coalesce("n", F.lit(0)))


def _offset_faults(reader: EdgeReader, rows: DataFrame, per_part: DataFrame, kind: str) -> list[DataFrame]:
    p, size = F.col("part"), reader.part_size
    main = F.col(lay.ends(reader.layout)[0])
    offsets = reader.all_offsets().select(F.col(lay.PART).alias("part"), "place", F.col(names.OFFSET).alias("at"))
    table = offsets.groupBy("part").agg(F.count("*").alias("n"), F.min_by("at", "place").alias("first"), F.max_by("at", "place").alias("final"))
    known = per_part.join(table, "part", "left")
    out = [
        _faults(known, "offset_rows", kind, p, None, F.coalesce("n", F.lit(0)), F.lit(size + 1)),
        _faults(known.filter("n > 0"), "offset_first", kind, p, None, F.col("first"), F.lit(0)),
        _faults(known.filter("n > 0"), "offset_last", kind, p, None, F.col("final"), F.col("held")),
    ]
    # a vertex's offsets are those at its place and the next one
    spread = offsets.select("part", F.explode(F.array(F.struct("place", F.col("at").alias(_BEGIN), F.lit(None).cast("long").alias(_END)), F.struct((F.col("place") - 1).alias("place"), F.lit(None).cast("long").alias(_BEGIN), F.col("at").alias(_END)))).alias("_o"))
    said = spread.select("part", "_o.*").filter(F.col("place").between(0, size - 1)).groupBy("part", "place").agg(F.max(_BEGIN).alias(_BEGIN), F.max(_END).alias(_END))
    position = F.col(KEYS[1]) * reader.info.chunk_size + F.col(KEYS[2])
    stand = rows.filter(main.isNotNull()).groupBy(F.col(KEYS[0]).alias("part"), (main - F.col(KEYS[0]) * size).alias("place")).agg(F.count("*").alias(_N), F.min(position).alias("low"), F.max(position).alias("high"))
    both = said.join(stand, ["part", "place"], "left")
    c = F.col("place")
    out.append(_faults(both.filter(F.col(_END) < F.col(_BEGIN)), "offset_falls", kind, p, c, F.col(_END), F.col(_BEGIN)))
    # without edges a vertex begins where it ends
    out.append(_faults(both, "edges_begin", kind, p, c, F.coalesce("low", F.col(_BEGIN)), F.col(_BEGIN)))
    out.append(_faults(both, "edges_end", kind, p, c, F.when(F.col(_N).isNull(), F.col(_BEGIN)).otherwise(F.col("high") + 1), F.col(_END)))
    out.append(_faults(both.filter(F.col(_N).isNotNull()), "edges_apart", kind, p, c, F.col("high") - F.col("low") + 1, F.col(_N)))
    return out


def faults(graph) -> DataFrame:
    """All faults of a stored graph's vertex types and of its edge types in all their layouts; none if it is sound."""
    counts = {v.type: graph.vertex_reader(v.type).count() for v in graph.info.vertices}
    out = [vertex_faults(graph.vertex_reader(v.type)) for v in graph.info.vertices]
    out += [edge_faults(graph.edge_reader(e.key, a.layout), counts[e.src_type], counts[e.dst_type]) for e in graph.info.edges for a in e.adj_lists]
    return reduce(DataFrame.unionByName, out) if out else graph.spark.createDataFrame([], SCHEMA)
