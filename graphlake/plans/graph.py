"""A graph as one object: reading, writing, transforming, and collections of vertices and edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import names
from ..errors import InvalidError, MissingKeyError
from ..functions import scalars
from ..functions.expressions import Expression
from ..operators import expansion, index, labels
from ..operators import layout as lay
from ..operators.expansion import MOST_FILES, listed
from ..session import cut
from ..sources.appender import EdgeAppender
from ..sources.fs import Files
from ..sources.reader import EdgeReader, VertexReader
from ..sources.writer import EdgeWriter, VertexWriter, write_label_bitmaps
from . import yaml_io
from .info import AdjList, GraphInfo, Layout, PropertyGroup, ValidateLevel, infer_edge, infer_vertex

Triple = tuple[str, str, str]


def load_info(spark: SparkSession, path: str) -> GraphInfo:
    """Metadata from a graph file and the files that it lists."""
    files = Files(spark)
    return yaml_io.load_graph(files.read_text(path), path.rsplit("/", 1)[0] if "/" in path else ".", files.read_text)


def save_info(spark: SparkSession, info: GraphInfo, folder: str | None = None) -> str:
    """Writes all metadata files to a folder (the graph's root unless named); returns the graph file's path."""
    info.validate()
    files, at = Files(spark), (folder or info.prefix).rstrip("/")
    for v in info.vertices:
        files.write_text(f"{at}/{yaml_io.vertex_file(v)}", yaml_io.dump_vertex(v))
    for e in info.edges:
        files.write_text(f"{at}/{yaml_io.edge_file(e)}", yaml_io.dump_edge(e))
    path = f"{at}/{yaml_io.graph_file(info)}"
    files.write_text(path, yaml_io.dump_graph(info))
    return path


@dataclass(frozen=True)
class Vertices:
    """Vertices of a type, maybe filtered; filters add up, and reach the scan of the columns that they need.

    Scans are of all chunks, or of `chunks`; where `known` is there, only its ids count.
    """

    reader: VertexReader
    where: tuple[Expression, ...] = ()
    labels: tuple[str, ...] = ()
    chunks: tuple[int, ...] | None = None
    known: DataFrame | None = None

    def with_label(self, *wanted: str) -> Vertices:
        """Those that have all the labels."""
        known = list(self.reader.info.labels)
        if missing := [x for x in wanted if x not in known]:
            raise MissingKeyError(f"unknown labels {missing}")
        return replace(self, labels=(*self.labels, *wanted))

    def with_property(self, where: Expression) -> Vertices:
        for name in where.properties():
            self.reader.info.group_of(name)
        return replace(self, where=(*self.where, where))

    def narrow(self, most: int = MOST_FILES) -> Vertices:
        """The same vertices, found now: what is asked of them from here on reads only the chunks that they are in.

        Their ids are kept in a checkpoint, so the filters so far aren't evaluated again; the driver gets the numbers
        of the chunks, `most` at most. Vertices in more chunks than that are scanned for in all.
        """
        ids = cut(self.ids())
        found = listed(ids.select(scalars.chunk_of(F.col(names.VERTEX), self.reader.info.chunk_size)), most)
        return Vertices(self.reader, chunks=None if found is None else tuple(c for (c,) in found), known=ids)

    def _flags(self) -> DataFrame:
        return labels.with_all(self.reader.label_flags(self.chunks), list(dict.fromkeys(self.labels)), list(self.reader.info.labels)).select(names.VERTEX)

    def _known(self, df: DataFrame) -> DataFrame:
        return df if self.known is None else df.join(self.known, names.VERTEX, "left_semi")

    def table(self, columns: list[str] | None = None) -> DataFrame:
        """id and columns (all unless named)."""
        wanted = self.reader.info.property_names if columns is None else columns
        condition = self.where[0] if self.where else None
        for more in self.where[1:]:
            condition = condition & more  # type: ignore[operator]
        df = self._known(self.reader.select(wanted, condition, self.chunks))
        return df.join(self._flags(), names.VERTEX, "left_semi") if self.labels else df

    def _bitmaps(self) -> DataFrame | None:
        """Bitmaps of what is asked for, if labels alone decide and they are stored."""
        if not self.labels or self.where or self.known is not None or not self.reader.has_label_bitmaps():
            return None
        return labels.bitmaps_with_all(self.reader.label_bitmaps(), list(self.labels), list(self.reader.info.labels))

    def with_any_label(self, *wanted: str) -> DataFrame:
        """Ids of the vertices that have any of the labels."""
        known = list(self.reader.info.labels)
        if self.reader.has_label_bitmaps():
            found = labels.ids_of(labels.bitmaps_with_any(self.reader.label_bitmaps(), list(wanted), known))
        else:
            found = labels.with_any(self.reader.label_flags(self.chunks), list(wanted), known).select(names.VERTEX)
        return found.join(self.ids(), names.VERTEX, "left_semi") if self.where or self.labels or self.known is not None else found

    def ids(self) -> DataFrame:
        if (found := self._bitmaps()) is not None:
            return labels.ids_of(found)
        if self.where or not (self.labels or self.known is not None):
            return self.table([])
        return self._known(self._flags()) if self.labels else self.known  # type: ignore[return-value]

    def count(self) -> int:
        if (found := self._bitmaps()) is not None:
            return labels.bitmap_total(found).head()[0]
        return self.reader.count() if not (self.where or self.labels or self.known is not None) else self.ids().count()

    def find(self, vertex: int) -> Vertex:
        """One vertex by its id; only its chunk of each group is read."""
        info, number = self.reader.info, vertex // self.reader.info.chunk_size
        df = None
        for g in info.groups:
            rows = self.reader.chunk(g, number).filter(F.col(names.VERTEX) == vertex)
            df = rows if df is None else df.join(rows, names.VERTEX)
        row = df.first() if df is not None else None
        if row is None:
            raise MissingKeyError(f"no vertex {vertex}")
        return Vertex(self.reader, row)

    def __iter__(self) -> Iterator[Vertex]:
        """All vertices in the order of their ids, a partition at a time."""
        return (Vertex(self.reader, row) for row in self.table().orderBy(names.VERTEX).toLocalIterator())


class _Element:
    row: Row

    def property(self, name: str) -> Any:
        if name not in self.row.asDict():
            raise MissingKeyError(f"no property {name!r}")
        return self.row[name]

    def is_valid(self, name: str) -> bool:
        """Whether the property has a value."""
        return self.property(name) is not None


@dataclass(frozen=True)
class Vertex(_Element):
    reader: VertexReader
    row: Row

    @property
    def id(self) -> int:
        return self.row[names.VERTEX]

    def labels(self) -> list[str]:
        if not self.reader.info.labels:
            return []
        flags = self.reader.label_flags(self.id // self.reader.info.chunk_size).filter(F.col(names.VERTEX) == self.id).first()
        return [x for x in self.reader.info.labels if flags and flags[x]]

    def has_label(self, label: str) -> bool:
        if label not in self.reader.info.labels:
            raise MissingKeyError(f"unknown label {label!r}")
        return label in self.labels()


@dataclass(frozen=True)
class Edge(_Element):
    row: Row

    @property
    def source(self) -> int:
        return self.row[names.SRC]

    @property
    def destination(self) -> int:
        return self.row[names.DST]


@dataclass(frozen=True)
class Edges:
    """Edges of a type in one layout, maybe of a range of parts only."""

    reader: EdgeReader
    parts: range | None = None

    def between(self, begin: int, end: int) -> Edges:
        """Those of the vertex chunks begin..end-1."""
        if not 0 <= begin <= end <= self.reader.part_count():
            raise InvalidError(f"no vertex chunks {begin}..{end}")
        return replace(self, parts=range(begin, end))

    def table(self, columns: list[str] | None = None, add_index: bool = False) -> DataFrame:
        return self.reader.edges(add_index=add_index, parts=self.parts, columns=columns)

    def count(self) -> int:
        return self.reader.count() if self.parts is None else sum(self.reader.count(p) for p in self.parts)

    def _near(self, vertex: int, column: str, aligned: bool, columns: list[str] | None) -> DataFrame:
        """Edges at a vertex: one part of the layout if it is aligned with that end, else a scan with a filter."""
        if aligned:
            part = vertex // self.reader.part_size
            if self.parts is not None and part not in self.parts:
                return self.table(columns).limit(0)
            return self.reader.edges(part, add_index=False, columns=columns).filter(F.col(column) == vertex)
        return self.table(columns).filter(F.col(column) == vertex)

    def out_edges(self, vertex: int, columns: list[str] | None = None) -> DataFrame:
        return self._near(vertex, names.SRC, self.reader.layout.by_source, columns)

    def in_edges(self, vertex: int, columns: list[str] | None = None) -> DataFrame:
        return self._near(vertex, names.DST, not self.reader.layout.by_source, columns)

    def at(self, frontier: DataFrame | Vertices, columns: list[str] | None = None) -> DataFrame:
        """Edges that have one of many vertices at the layout's end; only the chunks that hold them are read."""
        ids = frontier.ids() if isinstance(frontier, Vertices) else frontier
        rows = expansion.expand(self.reader, ids, columns)
        return rows if self.parts is None else rows.filter(scalars.chunk_of(F.col(lay.ends(self.reader.layout)[0]), self.reader.part_size).between(self.parts.start, self.parts.stop - 1))

    def adjacency_range(self, vertex: int) -> tuple[int, int]:
        """Where a vertex's edges begin and end in its part."""
        part, place = divmod(vertex, self.reader.part_size)
        rows = self.reader.offsets(part).filter(F.col("place").isin(place, place + 1)).orderBy("place").collect()
        return rows[0][names.OFFSET], rows[1][names.OFFSET]

    def __iter__(self) -> Iterator[Edge]:
        rows = self.table(add_index=True).orderBy(names.EDGE)
        return (Edge(row) for row in rows.toLocalIterator())


@dataclass
class Graph:
    """A stored graph: metadata and readers."""

    spark: SparkSession
    info: GraphInfo

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark, load_info(spark, path))

    def vertex_reader(self, kind: str) -> VertexReader:
        return VertexReader(self.spark, self.info.prefix, self.info.vertex(kind))

    def edge_reader(self, key: Triple, layout: Layout | None = None) -> EdgeReader:
        info = self.info.edge(*key)
        return EdgeReader(self.spark, self.info.prefix, info, layout or info.adj_lists[0].layout)

    def vertices(self, kind: str) -> Vertices:
        return Vertices(self.vertex_reader(kind))

    def edges(self, key: Triple, layout: Layout | None = None) -> Edges:
        return Edges(self.edge_reader(key, layout))

    def tables(self) -> tuple[dict[str, DataFrame], dict[Triple, dict[Layout, DataFrame]]]:
        """All vertex tables by type, and all edge tables by type and layout; nothing is read yet."""
        vertices = {}
        for v in self.info.vertices:
            reader = self.vertex_reader(v.type)
            stored = v.labels and reader.files.exists(reader.prefix + v.labels_path())
            vertices[v.type] = reader.with_labels() if stored else reader.all()
        edges = {e.key: {a.layout: self.edge_reader(e.key, a.layout).edges(add_index=False) for a in e.adj_lists} for e in self.info.edges}
        return vertices, edges

    def register_views(self) -> None:
        """Temporary views for SQL: one per vertex type, one per edge type."""
        vertices, edges = self.tables()
        for kind, df in vertices.items():
            df.createOrReplaceTempView(kind)
        for key, by_layout in edges.items():
            next(iter(by_layout.values())).createOrReplaceTempView(names.SEPARATOR.join(key))

    def append_edges(self, key: Triple, edges: DataFrame, batch: int | None = None, on_dangling: str = "drop", **settings: Any) -> dict[Layout, int]:
        """Merges edges into all layouts of a type; how many each has then.

        The ends are ids, or else keys of the stored vertices in the first two columns. A batch that is repeated, also
        after a failure between two layouts, goes into each layout once.
        """
        info = self.info.edge(*key)
        if names.SRC not in edges.columns:
            keyed = [self.info.vertex(kind) for kind in (info.src_type, info.dst_type)]
            maps = [index.mapping_of(self.vertex_reader(v.type).select([v.primary_key]), v.primary_key) for v in keyed]
            edges = index.both_indexes(edges, *maps, on_dangling=on_dangling)
        ids, out = cut(edges), {}
        for adj in info.adj_lists:
            aligned = info.src_type if adj.layout.by_source else info.dst_type
            out[adj.layout] = EdgeAppender(self.spark, self.info.prefix, info, adj.layout, **settings).append(ids, self.vertex_reader(aligned).count(), batch)
        return out

    def add_label_bitmaps(self, kind: str) -> Graph:
        """Writes bitmaps of a type's stored labels; no other file changes."""
        reader = self.vertex_reader(kind)
        write_label_bitmaps(self.spark, self.info.prefix, reader.info, reader.label_flags())
        return self

    def add_vertex_group(self, kind: str, group: PropertyGroup, values: DataFrame) -> Graph:
        """Writes a new property group (`values`: id and its columns) and its metadata; no other file changes."""
        old = self.info.vertex(kind)
        new = old.add_group(group)
        VertexWriter(self.info.prefix, replace(new, groups=(group,), labels=()), values, count=self.vertex_reader(kind).count()).write_group(group)
        out = Graph(self.spark, self.info.put_vertex(new))
        save_info(self.spark, out.info)
        return out


@dataclass
class GraphWriter:
    """Collects vertex and edge tables and writes them as a graph."""

    spark: SparkSession
    vertices: dict[str, tuple[DataFrame, str | None, tuple[str, ...]]] = field(default_factory=dict)
    edges: dict[Triple, tuple[DataFrame, str | None, str | None]] = field(default_factory=dict)

    def put_vertices(self, kind: str, df: DataFrame, key: str | None = None, labels: tuple[str, ...] = ()) -> GraphWriter:
        if kind in self.vertices:
            raise InvalidError(f"vertex type {kind!r} is there already")
        self.vertices[kind] = (df, key, tuple(labels))
        return self

    def put_edges(self, key: Triple, df: DataFrame, src: str | None = None, dst: str | None = None) -> GraphWriter:
        """The ends are keys of the vertices, in the first two columns unless named."""
        if key in self.edges:
            raise InvalidError(f"edge type {key} is there already")
        self.edges[key] = (df, src, dst)
        return self

    def infer(self, name: str, prefix: str, vertex_chunk_size: int = names.VERTEX_CHUNK_SIZE, edge_chunk_size: int = names.EDGE_CHUNK_SIZE, file_type: str = names.FILE_TYPE, layouts: tuple[Layout, ...] = (Layout.BY_SOURCE, Layout.BY_DEST)) -> GraphInfo:
        """Metadata from the tables' columns: one group for each type."""
        vertices = tuple(infer_vertex(k, df.schema, key, vertex_chunk_size, file_type, lab) for k, (df, key, lab) in self.vertices.items())
        edges = tuple(
            infer_edge(k, df.schema, (src or df.columns[0], dst or df.columns[1]), (edge_chunk_size, vertex_chunk_size, vertex_chunk_size), file_type, layouts=layouts) for k, (df, src, dst) in self.edges.items()
        )
        return GraphInfo(name, prefix, vertices, edges)

    def write(self, info: GraphInfo, level: ValidateLevel = ValidateLevel.WEAK, on_dangling: str = "drop", options: dict[str, dict[str, Any]] | None = None, column_prefix: str = names.PREFIX, label_bitmaps: bool = False, encoded: bool = False) -> Graph:
        """Writes data and metadata. Vertex ids stand in the order of the keys; edges are rewritten from keys to ids.

        label_bitmaps: bitmaps too where a type has labels. encoded: Parquet files with ids as differences and flags as
        runs; any reader of Parquet decodes them.
        """
        info.validate()
        if missing := [v.type for v in info.vertices if v.type not in self.vertices] + [e.key for e in info.edges if e.key not in self.edges]:
            raise MissingKeyError(f"no data for {missing}")
        settings: dict[str, Any] = {"options": options, "column_prefix": column_prefix, "level": level, "encoded": encoded}
        mappings, counts = {}, {}
        for v in info.vertices:
            df, key, _ = self.vertices[v.type]
            key = key or v.primary_key or df.columns[0]
            if level is ValidateLevel.STRONG:
                index.require_unique(df, key)
            # ids that are made here stand in a checkpoint; a table that brings its own is read once too
            indexed = cut(df) if names.VERTEX in df.columns else index.vertex_index(df, key)
            writer = VertexWriter(info.prefix, v, indexed, **settings)
            writer.write()
            if label_bitmaps and v.labels and names.LABELS in indexed.columns:
                writer.write_label_bitmaps()
            counts[v.type] = writer.count
            mappings[v.type] = index.mapping_of(indexed, key)
        for e in info.edges:
            df, src, dst = self.edges[e.key]
            ids = cut(df if names.SRC in df.columns else index.both_indexes(df, mappings[e.src_type], mappings[e.dst_type], src, dst, on_dangling))
            for adj in e.adj_lists:
                aligned = e.src_type if adj.layout.by_source else e.dst_type
                EdgeWriter(info.prefix, e, adj.layout, counts[aligned], ids, **settings).write()
        save_info(self.spark, info)
        return Graph(self.spark, info)


def transform(source: Graph, target: GraphInfo, **settings: Any) -> Graph:
    """Writes the target's types from the source: other file types, chunk sizes, groups or layouts.

    Types and properties must be in the source; ids stay as they are.
    """
    target.validate()
    spark = source.spark
    counts = {}
    for v in target.vertices:
        reader = source.vertex_reader(v.type)
        counts[v.type] = reader.count()
        df = reader.select(v.property_names)
        if v.labels and reader.files.exists(reader.prefix + reader.info.labels_path()):
            df = df.join(reader.labels(), names.VERTEX, "left")
        VertexWriter(target.prefix, v, df, counts[v.type], **settings).write()
    for e in target.edges:
        old = source.info.edge(*e.key)
        df = source.edge_reader(e.key, old.adj_lists[0].layout).edges(add_index=False, columns=e.property_names)
        for adj in e.adj_lists:
            kind = e.src_type if adj.layout.by_source else e.dst_type
            n = counts.get(kind) or source.vertex_reader(kind).count()
            EdgeWriter(target.prefix, e, adj.layout, n, df, **settings).write()
    save_info(spark, target)
    return Graph(spark, target)


def relayout(info: GraphInfo, prefix: str, file_type: str | None = None, vertex_chunk: int | None = None, edge_chunk: int | None = None, layouts: tuple[Layout, ...] | None = None) -> GraphInfo:
    """A target for transform(): the same types with other settings."""
    def groups(gs: tuple[PropertyGroup, ...]) -> tuple[PropertyGroup, ...]:
        return tuple(replace(g, file_type=file_type or g.file_type) for g in gs)

    vertices = tuple(replace(v, chunk_size=vertex_chunk or v.chunk_size, groups=groups(v.groups)) for v in info.vertices)
    edges = []
    for e in info.edges:
        adj = tuple(AdjList(x, file_type or e.adj_lists[0].file_type) for x in layouts) if layouts else tuple(replace(a, file_type=file_type or a.file_type) for a in e.adj_lists)
        edges.append(replace(e, chunk_size=edge_chunk or e.chunk_size, src_chunk_size=vertex_chunk or e.src_chunk_size, dst_chunk_size=vertex_chunk or e.dst_chunk_size, adj_lists=adj, groups=groups(e.groups)))
    return replace(info, prefix=prefix, vertices=vertices, edges=tuple(edges))

