"""Neighbours of many vertices through offsets: only the chunk files that hold their edges are listed and read.

The ids of a frontier meet the offset files of their parts; where their edges begin and end gives chunk numbers, and
the scan is of these chunks. What comes to the driver are numbers of parts and chunks, at most MOST_FILES of each: a
frontier that needs more of them reads the whole layout, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names
from ..functions import scalars
from ..session import cut
from ..sources.reader import EdgeReader
from . import layout as lay

V, S, D = names.VERTEX, names.SRC, names.DST
#: Files that a scan lists by name, and ids that are given to it as a filter, at most.
MOST_FILES, FEW_IDS = 20_000, 500
_BEGIN, _END, _PLACE = map(names.hidden, ("begin", "end", "place"))


def listed(df: DataFrame, most: int) -> list[tuple] | None:
    """Distinct rows of numbers, in order; None where there are more than `most`."""
    rows = df.distinct().limit(most + 1).collect()
    return sorted(map(tuple, rows)) if len(rows) <= most else None


def ranges(reader: EdgeReader, ids: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(id, part, begin, end): where the edges of each id stand in its part; ids without edges are left out."""
    size = reader.part_size
    placed = ids.select(V, scalars.chunk_of(F.col(V), size).alias(lay.PART), scalars.place_in_chunk(F.col(V), size).alias(_PLACE))
    parts = listed(placed.select(lay.PART), most)
    offsets = reader.all_offsets(None if parts is None else [p for (p,) in parts]) if parts != [] else reader.all_offsets().limit(0)
    both = placed.withColumn("place", F.explode(F.array(F.col(_PLACE), F.col(_PLACE) + 1)))
    found = both.join(offsets, [lay.PART, "place"]).groupBy(V, lay.PART).agg(F.min(names.OFFSET).alias(_BEGIN), F.max(names.OFFSET).alias(_END))
    return found.filter(F.col(_END) > F.col(_BEGIN))


def chunks_of(reader: EdgeReader, found: DataFrame, most: int = MOST_FILES) -> list[tuple[int, int]] | None:
    """(part, chunk) of all chunks that such ranges touch."""
    size = reader.info.chunk_size
    first, last = (scalars.chunk_of(c, size) for c in (F.col(_BEGIN), F.col(_END) - 1))
    return listed(found.select(lay.PART, F.explode(F.sequence(first, last)).alias(lay.CHUNK)), most)


def expand(reader: EdgeReader, frontier: DataFrame, columns: list[str] | None = None, most: int = MOST_FILES) -> DataFrame:
    """Edges (src, dst, columns) that have an id of the frontier at the end by which the layout is aligned.

    Null, repeated and unknown ids count nothing. Layouts without offsets are scanned.
    """
    end = lay.ends(reader.layout)[0]
    ids = cut(frontier.select(F.col(V).cast("long")).filter(F.col(V).between(0, reader.vertex_count() - 1)).distinct())
    chunks = chunks_of(reader, ranges(reader, ids, most), most) if reader.layout.ordered else None
    rows = reader.edges(add_index=False, columns=columns) if chunks is None else reader.chunk_edges(chunks, columns)
    few = listed(ids, FEW_IDS)
    if few is not None:  # the filter reaches the files, whose statistics leave out what lies between
        return rows.filter(F.col(end).isin([i for (i,) in few]))
    return rows.join(ids.withColumnRenamed(V, end), end, "left_semi").select(*rows.columns)


def step(reader: EdgeReader, frontier: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """Distinct ids at the other ends of the frontier's edges."""
    return expand(reader, frontier, [], most).select(F.col(lay.ends(reader.layout)[1]).alias(V)).distinct()


def hops(reader: EdgeReader, frontier: DataFrame, k: int, most: int = MOST_FILES) -> DataFrame:
    """Distinct ids that k edges lead to, one after the other; paths may lead back."""
    for _ in range(k):
        frontier = step(reader, frontier, most)
    return frontier


def search(reader: EdgeReader, roots: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(id, distance) of all ids that edges lead to from any of the roots; each level reads its own chunks only."""
    reached = cut(roots.select(F.col(V).cast("long")).filter(F.col(V).between(0, reader.vertex_count() - 1)).distinct().withColumn("distance", F.lit(0)))
    frontier, level = reached, 0
    while not frontier.isEmpty():
        level += 1
        frontier = cut(step(reader, frontier, most).join(reached, V, "left_anti").withColumn("distance", F.lit(level)))
        reached = cut(reached.unionByName(frontier))
    return reached
