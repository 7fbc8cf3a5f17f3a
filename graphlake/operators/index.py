"""Dense ids of vertices and edges, and the rewriting of edges from keys to ids and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from ..errors import InvalidError, MissingKeyError
from .ranking import number_rows


def vertex_index(df: DataFrame, key: str | None = None) -> DataFrame:
    """Prepends the dense id (from 0) in the order of the key (the first column unless named)."""
    key = key or df.columns[0]
    if key not in df.columns:
        raise MissingKeyError(f"no column {key!r}")
    return number_rows(df, [F.col(key)], names.VERTEX).select(names.VERTEX, *df.columns)


def index_mapping(df: DataFrame, key: str | None = None) -> DataFrame:
    """(primary, id) of each vertex."""
    key = key or df.columns[0]
    return mapping_of(vertex_index(df.select(key), key), key)


def mapping_of(indexed: DataFrame, key: str) -> DataFrame:
    return indexed.select(F.col(key).alias(names.PRIMARY), names.VERTEX)


def index_with_mapping(df: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    indexed = vertex_index(df, key)
    return indexed, mapping_of(indexed, key or df.columns[0])


def edge_index(edges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Prepends the edge id (from 0) in the order of the given columns (all unless named)."""
    return number_rows(edges, [F.col(c) for c in order or edges.columns], names.EDGE).select(names.EDGE, *edges.columns)


def _attach(edges: DataFrame, mapping: DataFrame, column: str, index: str, how: str = "inner") -> DataFrame:
    key = names.hidden("key")
    known = mapping.select(F.col(names.PRIMARY).alias(key), F.col(names.VERTEX).alias(index))
    joined = edges.join(known, F.col(f"`{column}`") == F.col(key), how)
    return joined.select(index, *[f"`{c}`" for c in edges.columns if c != column])


def source_index(edges: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Source keys to ids; edges without a vertex go."""
    return _attach(edges, mapping, column, names.SRC)


def dest_index(edges: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    return _attach(edges, mapping, column, names.DST)


def both_indexes(edges: DataFrame, src_mapping: DataFrame, dst_mapping: DataFrame, src: str | None = None, dst: str | None = None, on_dangling: str = "drop") -> DataFrame:
    """Both ends to ids: src id, dst id, then the other columns. The ends are the first two columns unless named.

    Edges without a vertex at an end are dropped, or with on_dangling="error" refused.
    """
    src, dst = src or edges.columns[0], dst or edges.columns[1]
    if on_dangling == "error" and not dangling_edges(edges, src_mapping, dst_mapping, src, dst).isEmpty():
        raise MissingKeyError("edges lead to keys that no vertex has")
    with_dst = dest_index(edges, dst_mapping, dst)
    rest = [f"`{c}`" for c in edges.columns if c not in (src, dst)]
    return source_index(with_dst, src_mapping, src).select(names.SRC, names.DST, *rest)


def dangling_edges(edges: DataFrame, src_mapping: DataFrame, dst_mapping: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges of which an end is no vertex (null keys included)."""
    s, d = names.hidden("s"), names.hidden("d")
    found = edges
    for mapping, column, end in ((src_mapping, src, s), (dst_mapping, dst, d)):
        found = found.join(mapping.select(F.col(names.PRIMARY).alias(end)), F.col(f"`{column}`") == F.col(end), "left")
    return found.filter(F.col(s).isNull() | F.col(d).isNull()).select(*(f"`{c}`" for c in edges.columns))


def require_unique(df: DataFrame, key: str) -> None:
    """Refuses tables in which a key repeats or is null."""
    if not df.filter(F.col(key).isNull()).isEmpty():
        raise InvalidError(f"key {key!r} has nulls")
    if not df.groupBy(key).count().filter("count > 1").isEmpty():
        raise InvalidError(f"key {key!r} repeats")


def source_index_alone(edges: DataFrame, column: str) -> DataFrame:
    """Source ids in a space of their own: the distinct sources in order."""
    return source_index(edges, index_mapping(edges.select(column).distinct()), column)


def dest_index_alone(edges: DataFrame, column: str) -> DataFrame:
    return dest_index(edges, index_mapping(edges.select(column).distinct()), column)


def united_keys(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("key")).union(edges.select(F.col(dst).alias("key"))).filter("key is not null").distinct()


def united_index(edges: DataFrame, src: str | None = None, dst: str | None = None) -> DataFrame:
    """Both ends to ids of one space: the distinct keys of either end in order."""
    src, dst = src or edges.columns[0], dst or edges.columns[1]
    mapping = index_mapping(united_keys(edges, src, dst))
    return both_indexes(edges, mapping, mapping, src, dst)


def to_primary_keys(edges: DataFrame, src_mapping: DataFrame, dst_mapping: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Ids back to keys: src, dst, then the other columns."""
    def key(mapping: DataFrame, index: str, name: str) -> DataFrame:
        return mapping.select(F.col(names.VERTEX).alias(index), F.col(names.PRIMARY).alias(name))

    rest = [f"`{c}`" for c in edges.columns if c not in (names.SRC, names.DST)]
    return edges.join(key(src_mapping, names.SRC, src), names.SRC).join(key(dst_mapping, names.DST, dst), names.DST).select(src, dst, *rest)


def merge_columns(left: DataFrame, right: DataFrame, key: str | None = None) -> DataFrame:
    """Columns of two sources side by side: by a shared key, or by place, where the numbers of rows must be equal."""
    if key is not None:
        return left.join(right, key)
    if left.count() != right.count():
        raise InvalidError("sources to merge by place have unlike numbers of rows")
    schema = left.schema.fields + right.schema.fields
    at, place = names.hidden("order"), names.hidden("number")
    numbered = [df.withColumn(at, _place()) for df in (left, right)]
    sides = [number_rows(df, [F.col(at)], place).drop(at) for df in numbered]
    return sides[0].join(sides[1], place).select(*(f"`{f.name}`" for f in schema))


def _place() -> Column:
    return F.monotonically_increasing_id()
