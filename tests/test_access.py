"""Reading little of a stored graph: files that expansions and chained filters read, against the whole tables."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphlake import names
from graphlake.errors import MissingKeyError
from graphlake.functions.expressions import Property as P
from graphlake.operators import expansion, labels
from graphlake.plans.graph import GraphWriter
from graphlake.plans.info import Layout
from graphlake.sources.writer import VertexWriter

V, S, D = names.VERTEX, names.SRC, names.DST
KEY = ("person", "knows", "person")
N = 60
#: Person 7 is a hub of three chunks; persons from 40 on have no edges out.
PAIRS = sorted({(i, (i * 7 + 3) % N, i) for i in range(40)} | {(i, (i * 11 + 1) % N, 100 + i) for i in range(0, 40, 3)} | {(7, j, 1000 + j) for j in range(24)})


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    people = spark.createDataFrame([(i, f"n{i}", ["low"] if i < 9 else ["high", "odd"] if i % 2 else ["high"]) for i in range(N)], f"id long, name string, `{names.LABELS}` array<string>")
    pairs = spark.createDataFrame(PAIRS, "src long, dst long, w int").repartition(3)
    writer = GraphWriter(spark).put_vertices("person", people, "id", ("low", "high", "odd")).put_edges(KEY, pairs, "src", "dst")
    return writer.write(writer.infer("g", f"{tmp_path_factory.mktemp('g')}/", 10, 8, layouts=(Layout.BY_SOURCE, Layout.BY_DEST, Layout.LOOSE_BY_SOURCE)))


def files(df):
    return sorted("/".join(f.rsplit("/", 3)[1:]) for f in df.inputFiles())


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], f"{V} long")


def test_expansion_reads_the_chunks_that_hold_the_edges(spark, stored):
    reader = stored.edge_reader(KEY, Layout.BY_SOURCE)
    got = expansion.expand(reader, ids(spark, [23, 23, None, 45, 999, -1]))
    assert sorted(map(tuple, got.collect())) == [e for e in PAIRS if e[0] == 23]
    assert files(got) == ["adj_list/part2/chunk0", "w/part2/chunk0"]
    hub = expansion.expand(reader, ids(spark, [7]), [])
    assert sorted(map(tuple, hub.collect())) == sorted((s, d) for s, d, _ in PAIRS if s == 7)
    first = sum(s < 7 for s, _, _ in PAIRS)
    assert files(hub) == [f"adj_list/part0/chunk{k}" for k in range(first // 8, (first + sum(s == 7 for s, _, _ in PAIRS) - 1) // 8 + 1)]
    for none in ([], [45, 50], [999]):
        empty = expansion.expand(reader, ids(spark, none))
        assert empty.count() == 0 and files(empty) == [] and empty.columns == [S, D, "w"]


def test_offsets_of_hit_parts_only(spark, stored, monkeypatch):
    reader, read = stored.edge_reader(KEY, Layout.BY_SOURCE), []
    whole = type(reader).all_offsets
    monkeypatch.setattr(type(reader), "all_offsets", lambda self, parts=None: read.append(parts) or whole(self, parts))
    expansion.expand(reader, ids(spark, [2, 31, 33])).count()
    assert read == [[0, 3]]


@pytest.mark.parametrize("most", [1, 20_000])
@pytest.mark.parametrize("layout", [Layout.BY_SOURCE, Layout.BY_DEST, Layout.LOOSE_BY_SOURCE])
def test_expansion_against_a_scan(spark, stored, monkeypatch, layout, most):
    """Whatever the layout, the number of files that may be listed, and the size of the frontier."""
    reader, end = stored.edge_reader(KEY, layout), 0 if layout.by_source else 1
    for few in (0, 500):
        monkeypatch.setattr(expansion, "FEW_IDS", few)
        wanted = [3, 7, 8, 30, 59]
        got = expansion.expand(reader, ids(spark, wanted), ["w"], most)
        assert sorted(map(tuple, got.collect())) == [e for e in PAIRS if e[end] in wanted]


def test_hops_and_search(spark, stored):
    reader = stored.edge_reader(KEY, Layout.BY_SOURCE)
    after = lambda of: {d for s, d, _ in PAIRS if s in of}
    assert {r[0] for r in expansion.hops(reader, ids(spark, [1, 30]), 2).collect()} == after(after({1, 30}))
    want, level, reached = {}, 0, {12}
    while reached - want.keys():
        want |= dict.fromkeys(reached - want.keys(), level)
        level, reached = level + 1, after(reached)
    assert dict(map(tuple, expansion.search(reader, ids(spark, [12])).collect())) == want
    assert expansion.search(reader, ids(spark, [])).count() == 0


def test_edges_at_filtered_vertices(stored):
    edges = stored.edges(KEY, Layout.BY_SOURCE)
    people = stored.vertices("person").with_label("odd").with_property(P("id") < 30)
    odd = {i for i in range(9, 30) if i % 2}
    assert sorted(map(tuple, edges.at(people).collect())) == [e for e in PAIRS if e[0] in odd]
    assert sorted(map(tuple, edges.between(1, 2).at(people).collect())) == [e for e in PAIRS if e[0] in odd and 10 <= e[0] < 20]


def test_chained_filters_skip_chunks(stored):
    people = stored.vertices("person")
    low = people.with_label("low").narrow()
    assert low.chunks == (0,) and low.count() == 9
    names_of = low.table(["name"])
    assert files(names_of) and {f.rsplit("/", 1)[1] for f in names_of.inputFiles() if "id_name" in f} == {"chunk0"}
    some = people.with_property((P("id") == 12) | (P("id") == 13) | (P("id") == 55)).narrow()
    assert some.chunks == (1, 5)
    odd = some.with_label("odd")
    assert {f.rsplit("/", 1)[1] for f in odd.ids().inputFiles() if "/labels/" in f} == {"chunk1", "chunk5"}
    assert sorted(r[0] for r in odd.ids().collect()) == [13, 55] and [r["name"] for r in odd.with_property(P("id") > 20).table(["name"]).collect()] == ["n55"]
    again = odd.narrow().narrow()
    assert again.count() == 2 and sorted(r["name"] for r in again.table().collect()) == ["n13", "n55"]


def test_chains_without_hits_or_with_many(stored):
    people = stored.vertices("person")
    none = people.with_property(P("id") > 1_000).narrow()
    assert none.chunks == () and none.count() == 0 and none.with_label("low").table().count() == 0
    many = people.with_label("high").narrow(most=2)
    assert many.chunks is None and many.count() == 51 and many.with_property(P("id") < 12).table().count() == 3
    assert people.narrow().count() == N


def test_bitmaps_as_flags(spark, tmp_path):
    """Across ends of buckets, for labels that nobody or everybody has, with bitmaps or without."""
    size = 40_000
    rows = spark.range(size).select(F.col("id").alias("key"), F.array_compact(F.array(F.lit("all"), F.when(F.col("id") % 7 == 0, F.lit("a")), F.when(F.col("id") % 5 == 0, F.lit("b")), F.when(F.col("id") == 32_768, F.lit("one")))).alias(names.LABELS))
    writer = GraphWriter(spark).put_vertices("v", rows, "key", ("all", "a", "b", "one", "none"))
    g = writer.write(writer.infer("g", f"{tmp_path}/", 16_384))
    cases = [("a",), ("a", "b"), ("a", "b", "all"), ("one", "all"), ("none",), ("none", "a"), ("b", "one"), ("a", "a")]
    plain = [sorted(r[0] for r in g.vertices("v").with_label(*x).ids().collect()) for x in cases]
    either = sorted(r[0] for r in g.vertices("v").with_any_label("one", "a", "none").collect())
    assert not g.vertex_reader("v").has_label_bitmaps() and plain[1] == list(range(0, size, 35))
    g.add_label_bitmaps("v")
    assert [sorted(r[0] for r in g.vertices("v").with_label(*x).ids().collect()) for x in cases] == plain
    assert [g.vertices("v").with_label(*x).count() for x in cases] == list(map(len, plain))
    assert sorted(r[0] for r in g.vertices("v").with_any_label("one", "a", "none").collect()) == either
    read = g.vertices("v").with_label("a", "b").ids().inputFiles()
    assert read and all("/label_bitmaps/" in f for f in read)  # no rows of flags
    assert "PushedFilters: [In(label" in g.vertices("v").with_label("a", "b").ids()._jdf.queryExecution().toString()
    counts = {r["label"]: r["n"] for r in labels.bitmap_counts(g.vertex_reader("v").label_bitmaps(), list(g.info.vertex("v").labels)).collect()}
    assert counts == {"all": size, "a": -(-size // 7), "b": size // 5, "one": 1, "none": 0}
    assert g.vertices("v").with_label("a").with_property(P("key") < 20).count() == 3
    assert g.vertices("v").with_label("a").narrow().with_label("b").count() == len(plain[1])
    with pytest.raises(MissingKeyError):
        g.vertices("v").with_any_label("what")
    VertexWriter(g.info.prefix, g.info.vertex("v"), g.vertices("v").table().withColumn(names.LABELS, F.array(F.lit("b")))).write()
    assert not g.vertex_reader("v").has_label_bitmaps() and g.vertices("v").with_label("b").count() == size


def footers(path):
    """Encodings of each column over all Parquet files below a folder, and the files' bytes."""
    found, total = {}, 0
    for at in sorted(Path(path).rglob("chunk*")):
        if at.is_file() and not at.name.endswith(".crc"):
            total += at.stat().st_size
            meta = pq.ParquetFile(at).metadata
            for k in range(meta.num_row_groups):
                for j in range(meta.num_columns):
                    column = meta.row_group(k).column(j)
                    found.setdefault(column.path_in_schema, set()).update(column.encodings)
    return found, total


def test_encodings_in_the_footers(spark, tmp_path):
    people = spark.range(3_000).select(F.col("id").alias("key"), F.when(F.col("id") < 900, F.array(F.lit("x"))).alias(names.LABELS))
    pairs = spark.range(60_000).select(F.pmod(F.hash("id"), F.lit(3_000)).cast("long").alias("s"), F.pmod(F.hash(-F.col("id")), F.lit(3_000)).cast("long").alias("d"), (F.col("id") % 3).cast("string").alias("kind"))
    sizes = {}
    for encoded in (False, True):
        at = f"{tmp_path}/{encoded}"
        writer = GraphWriter(spark).put_vertices("v", people, "key", ("x",)).put_edges(("v", "e", "v"), pairs)
        g = writer.write(writer.infer("g", f"{at}/", 1_000, 20_000, layouts=(Layout.BY_SOURCE,)), encoded=encoded, options={"parquet": {"compression": "none"}})
        adj, sizes[encoded] = footers(f"{at}/edge/v_e_v/ordered_by_source/adj_list")
        flags, props = footers(f"{at}/vertex/v/labels")[0], footers(f"{at}/edge/v_e_v/ordered_by_source/kind")[0]
        assert all(("DELTA_BINARY_PACKED" in adj[x]) == encoded for x in (S, D))
        assert ("PLAIN" in flags["x"]) == (not encoded) and props["kind"] & {"PLAIN_DICTIONARY", "RLE_DICTIONARY"}
        assert g.edge_reader(("v", "e", "v")).edges(add_index=False).join(pairs.toDF(S, D, "kind"), [S, D, "kind"], "left_anti").count() == 0
        assert g.edge_reader(("v", "e", "v")).edges().count() == 60_000 and g.vertices("v").with_label("x").count() == 900
    assert sizes[True] < 0.65 * sizes[False]
