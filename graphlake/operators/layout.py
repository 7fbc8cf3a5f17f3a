"""Physical arrangement: vertex chunks, and edges in parts and chunks with offsets and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import names
from ..errors import InvalidError
from ..functions import scalars
from ..plans.info import Layout
from .ranking import number_within

PART, CHUNK, POSITION = "part", "chunk", "position"


def chunks(n: int, size: int) -> int:
    """Chunks of `size` rows that n rows need."""
    if size <= 0:
        raise InvalidError("chunk size must be positive")
    return -(-n // size)


def with_vertex_chunk(vertices: DataFrame, size: int, name: str = CHUNK) -> DataFrame:
    return vertices.withColumn(name, scalars.chunk_of(F.col(names.VERTEX), size))


def vertex_chunk_sizes(vertices: DataFrame, size: int) -> DataFrame:
    return with_vertex_chunk(vertices, size).groupBy(CHUNK).agg(F.count("*").alias("rows"))


def ends(layout: Layout) -> tuple[str, str]:
    """The end that a layout is aligned with, and the other."""
    return (names.SRC, names.DST) if layout.by_source else (names.DST, names.SRC)


def arrange(edges: DataFrame, layout: Layout, part_size: int, chunk_size: int, ties: list[str] | None = None, added: tuple[str, str, str] = (PART, POSITION, CHUNK)) -> DataFrame:
    """Adds part, position in the part and chunk, under the names `added`.

    Parts go by the aligned end. Ordered layouts stand in the order of (aligned end, other end, ties); the others in
    that of the ties, or of the aligned end if there are none, which keeps them reproducible. No task holds a whole
    part, so hubs don't matter.
    """
    main, other = ends(layout)
    part, position, chunk = added
    own = edges.withColumn(part, scalars.chunk_of(F.col(main), part_size))
    by = [main, other, *(ties or [])] if layout.ordered or not ties else ties
    placed = number_within(own, [F.col(part)], [F.col(f"`{c}`") for c in by], position)
    return placed.withColumn(chunk, scalars.chunk_of(F.col(position), chunk_size))


def degrees(edges: DataFrame, end: str = names.SRC) -> DataFrame:
    """id and degree of the vertices that have an edge at this end."""
    return edges.groupBy(F.col(end).alias(names.VERTEX)).agg(F.count("*").alias("degree"))


def all_degrees(edges: DataFrame, vertices: int, end: str = names.SRC) -> DataFrame:
    """id and degree of all ids below `vertices`, 0 included."""
    ids = edges.sparkSession.range(vertices).withColumnRenamed("id", names.VERTEX)
    return ids.join(degrees(edges, end), names.VERTEX, "left").select(names.VERTEX, F.coalesce("degree", F.lit(0)).alias("degree"))


def offsets(edges: DataFrame, layout: Layout, part_size: int, vertices: int) -> DataFrame:
    """(part, place, offset): for each part part_size + 1 places, of which the first is 0 and the last the part's edges.

    Ids without edges, and those beyond the last vertex of a short part, count nothing. A window holds one part's ids,
    of which there are part_size.
    """
    if not layout.ordered:
        raise InvalidError(f"{layout.value} has no offsets")
    parts = chunks(vertices, part_size)
    counted = all_degrees(edges, parts * part_size, ends(layout)[0])
    placed = counted.select(scalars.chunk_of(F.col(names.VERTEX), part_size).alias(PART), (scalars.place_in_chunk(F.col(names.VERTEX), part_size) + 1).alias("place"), "degree")
    zero = edges.sparkSession.range(parts).select(F.col("id").alias(PART), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("degree"))
    run = Window.partitionBy(PART).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.unionByName(zero).select(PART, "place", F.sum("degree").over(run).cast("long").alias(names.OFFSET))


def edges_per_part(edges: DataFrame, layout: Layout, part_size: int, vertices: int) -> DataFrame:
    """(part, edges) of all parts, empty ones included."""
    counted = edges.groupBy(scalars.chunk_of(F.col(ends(layout)[0]), part_size).alias(PART)).agg(F.count("*").alias("n"))
    parts = edges.sparkSession.range(chunks(vertices, part_size)).withColumnRenamed("id", PART)
    return parts.join(counted, PART, "left").select(PART, F.coalesce("n", F.lit(0)).alias("edges"))


def edge_chunk_numbers(per_part: DataFrame, chunk_size: int) -> DataFrame:
    return per_part.select(PART, F.ceil(F.col("edges") / chunk_size).cast("long").alias("chunks"))


def adjacency_range(offset: DataFrame, part_size: int) -> DataFrame:
    """(vertex, begin, end) in its part's edges, from an offset table."""
    nxt = F.lead(names.OFFSET).over(Window.partitionBy(PART).orderBy("place"))
    rows = offset.select((F.col(PART) * part_size + F.col("place")).alias(names.VERTEX), F.col(names.OFFSET).alias("begin"), nxt.alias("end"))
    return rows.filter(F.col("end").isNotNull())


def global_chunks(per_part: DataFrame, chunk_size: int) -> DataFrame:
    """(global_chunk, part, chunk): chunks of all parts in one row of numbers. There is one row per part in the window."""
    numbered = edge_chunk_numbers(per_part, chunk_size)
    before = F.coalesce(F.sum("chunks").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = numbered.withColumn("_before", before).filter("chunks > 0")
    return each.select(PART, "_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias(CHUNK)).select((F.col("_before") + F.col(CHUNK)).alias("global_chunk"), PART, CHUNK)


def to_global_chunk(chunks_of_parts: list[int], part: int, chunk: int) -> int:
    """The number of (part, chunk) among all chunks."""
    if not 0 <= part < len(chunks_of_parts) or not 0 <= chunk < chunks_of_parts[part]:
        raise InvalidError(f"no chunk {chunk} in part {part}")
    return sum(chunks_of_parts[:part]) + chunk


def from_global_chunk(chunks_of_parts: list[int], number: int) -> tuple[int, int]:
    left = number
    for part, n in enumerate(chunks_of_parts):
        if 0 <= left < n:
            return part, left
        left -= n
    raise InvalidError(f"no chunk {number}")
