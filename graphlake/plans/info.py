"""Metadata of a graph: immutable, checked, and resolved to paths.

A vertex type has property groups (column groups) stored in chunks of a fixed number of rows. An edge type joins two
vertex types; it is stored once per adjacency layout, in parts aligned with the chunks of one end, and each part in
chunks of a fixed number of edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import types as T

from .. import names
from ..errors import InvalidError, MissingKeyError
from ..functions.types import Cardinality, GType

FILE_TYPES = ("parquet", "orc", "csv", "json")
DEFAULT_VERSION = "gl/v1"


class ValidateLevel(Enum):
    """How much writers check: nothing, schemas, or schemas and data."""

    NO = "no"
    WEAK = "weak"
    STRONG = "strong"


class Layout(Enum):
    """How edges are arranged: sorted or not, and by which end; the value is also the default folder."""

    BY_SOURCE = "ordered_by_source"
    BY_DEST = "ordered_by_dest"
    LOOSE_BY_SOURCE = "unordered_by_source"
    LOOSE_BY_DEST = "unordered_by_dest"

    @property
    def ordered(self) -> bool:
        return self in (Layout.BY_SOURCE, Layout.BY_DEST)

    @property
    def by_source(self) -> bool:
        return self in (Layout.BY_SOURCE, Layout.LOOSE_BY_SOURCE)

    @property
    def aligned_by(self) -> str:
        return "src" if self.by_source else "dst"

    @classmethod
    def of(cls, ordered: bool, aligned_by: str) -> Layout:
        if aligned_by not in ("src", "dst"):
            raise InvalidError(f"edges are aligned by src or dst, not {aligned_by!r}")
        return {(True, "src"): cls.BY_SOURCE, (True, "dst"): cls.BY_DEST, (False, "src"): cls.LOOSE_BY_SOURCE, (False, "dst"): cls.LOOSE_BY_DEST}[bool(ordered), aligned_by]


@dataclass(frozen=True)
class Version:
    """`<name>/v<number>`, with names of user-defined types in parentheses."""

    name: str = "gl"
    number: int = 1
    user_types: tuple[str, ...] = ()

    #: Types that version 1 knows.
    BUILT_IN = {1: ("bool", "int32", "int64", "float", "double", "string", "date", "timestamp", "list")}

    @classmethod
    def parse(cls, text: str) -> Version:
        m = re.fullmatch(r"\s*(\w+)/v(\d+)\s*(?:\(([^()]*)\))?\s*", str(text))
        if not m:
            raise InvalidError(f"not a version: {text!r}")
        return cls(m[1], int(m[2]), tuple(t.strip() for t in (m[3] or "").split(",") if t.strip()))

    def supports(self, kind: str) -> bool:
        base = kind.split("<")[0]
        return base in self.BUILT_IN.get(self.number, ()) or kind in self.user_types

    def __str__(self) -> str:
        return f"{self.name}/v{self.number}" + (f" ({','.join(self.user_types)})" if self.user_types else "")


@dataclass(frozen=True)
class Property:
    name: str
    type: GType
    primary: bool = False
    nullable: bool | None = None
    cardinality: Cardinality = Cardinality.SINGLE

    def __post_init__(self):
        if self.nullable is None:
            object.__setattr__(self, "nullable", not self.primary)

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, self.type.spark(self.cardinality), True)


def _unique(what: str, values: Iterable) -> None:
    seen: set = set()
    for v in values:
        if v in seen:
            raise InvalidError(f"{what} {v!r} appears twice")
        seen.add(v)


@dataclass(frozen=True)
class PropertyGroup:
    properties: tuple[Property, ...]
    file_type: str = names.FILE_TYPE
    prefix: str = ""

    def __post_init__(self):
        object.__setattr__(self, "properties", tuple(self.properties))
        if not self.prefix:
            object.__setattr__(self, "prefix", names.SEPARATOR.join(self.names) + "/")

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.properties]

    def has(self, name: str) -> bool:
        return name in self.names

    def schema(self) -> T.StructType:
        return T.StructType([p.field for p in self.properties])

    def validate(self) -> None:
        if not self.properties:
            raise InvalidError("a property group needs a property")
        if self.file_type not in FILE_TYPES:
            raise InvalidError(f"file type {self.file_type!r} is none of {FILE_TYPES}")
        if any(not p.name for p in self.properties):
            raise InvalidError("a property needs a name")
        _unique("property", self.names)
        for p in self.properties:
            if p.primary and p.nullable:
                raise InvalidError(f"primary property {p.name!r} can't be nullable")
            if self.file_type == "csv" and (p.type.name == "list" or p.cardinality is not Cardinality.SINGLE):
                raise InvalidError(f"csv can't store the list property {p.name!r}")


@dataclass(frozen=True)
class AdjList:
    layout: Layout
    file_type: str = names.FILE_TYPE
    prefix: str = ""

    def __post_init__(self):
        if not self.prefix:
            object.__setattr__(self, "prefix", self.layout.value + "/")

    def validate(self) -> None:
        if self.file_type not in FILE_TYPES:
            raise InvalidError(f"file type {self.file_type!r} is none of {FILE_TYPES}")


class _Groups:
    """What vertex and edge infos share: lookups by property and changes of groups."""

    groups: tuple[PropertyGroup, ...]

    def has_property(self, name: str) -> bool:
        return any(g.has(name) for g in self.groups)

    def has_group(self, group: PropertyGroup) -> bool:
        return group in self.groups

    def group_of(self, name: str) -> PropertyGroup:
        for g in self.groups:
            if g.has(name):
                return g
        raise MissingKeyError(f"no property {name!r}")

    def get_property(self, name: str) -> Property:
        return next(p for p in self.group_of(name).properties if p.name == name)

    def property_type(self, name: str) -> GType:
        return self.get_property(name).type

    def cardinality(self, name: str) -> Cardinality:
        return self.get_property(name).cardinality

    def is_primary(self, name: str) -> bool:
        return self.get_property(name).primary

    def is_nullable(self, name: str) -> bool:
        return bool(self.get_property(name).nullable)

    @property
    def primary_key(self) -> str | None:
        return next((p.name for g in self.groups for p in g.properties if p.primary), None)

    @property
    def property_names(self) -> list[str]:
        return [n for g in self.groups for n in g.names]

    def add_group(self, group: PropertyGroup):
        group.validate()
        if taken := [n for n in group.names if self.has_property(n)]:
            raise InvalidError(f"properties are there already: {taken}")
        return replace(self, groups=(*self.groups, group))  # type: ignore[type-var]

    def remove_group(self, group: PropertyGroup):
        if group not in self.groups:
            raise MissingKeyError("no such property group")
        return replace(self, groups=tuple(g for g in self.groups if g != group))  # type: ignore[type-var]


@dataclass(frozen=True)
class VertexInfo(_Groups):
    type: str
    chunk_size: int = names.VERTEX_CHUNK_SIZE
    groups: tuple[PropertyGroup, ...] = ()
    labels: tuple[str, ...] = ()
    prefix: str = ""
    version: Version = field(default_factory=Version)

    def __post_init__(self):
        object.__setattr__(self, "groups", tuple(self.groups))
        object.__setattr__(self, "labels", tuple(self.labels))
        if not self.prefix:
            object.__setattr__(self, "prefix", f"{self.type}/")

    def validate(self) -> None:
        if not self.type:
            raise InvalidError("a vertex type needs a name")
        if self.chunk_size <= 0:
            raise InvalidError("a vertex chunk needs a positive size")
        for g in self.groups:
            g.validate()
        _unique("property", self.property_names)
        _unique("label", self.labels)

    def count_path(self) -> str:
        return f"{self.prefix}vertex_count"

    def group_path(self, group: PropertyGroup) -> str:
        return f"{self.prefix}{group.prefix}"

    def chunk_path(self, group: PropertyGroup, chunk: int) -> str:
        return f"{self.group_path(group)}chunk{chunk}"

    def labels_path(self, chunk: int | None = None) -> str:
        return f"{self.prefix}labels/" + ("" if chunk is None else f"chunk{chunk}")

    def label_bitmaps_path(self) -> str:
        """Bitmaps of the labels, which a type may have beside them."""
        return f"{self.prefix}label_bitmaps/"


@dataclass(frozen=True)
class EdgeInfo(_Groups):
    src_type: str
    edge_type: str
    dst_type: str
    chunk_size: int = names.EDGE_CHUNK_SIZE
    src_chunk_size: int = names.VERTEX_CHUNK_SIZE
    dst_chunk_size: int = names.VERTEX_CHUNK_SIZE
    directed: bool = True
    adj_lists: tuple[AdjList, ...] = ()
    groups: tuple[PropertyGroup, ...] = ()
    prefix: str = ""
    version: Version = field(default_factory=Version)

    def __post_init__(self):
        object.__setattr__(self, "groups", tuple(self.groups))
        object.__setattr__(self, "adj_lists", tuple(self.adj_lists))
        if not self.prefix:
            object.__setattr__(self, "prefix", f"{self.concat()}/")

    def concat(self) -> str:
        return names.SEPARATOR.join(self.key)

    @property
    def key(self) -> tuple[str, str, str]:
        return self.src_type, self.edge_type, self.dst_type

    def validate(self) -> None:
        if not all(self.key):
            raise InvalidError("an edge type needs its three names")
        if min(self.chunk_size, self.src_chunk_size, self.dst_chunk_size) <= 0:
            raise InvalidError("chunks need positive sizes")
        if not self.adj_lists:
            raise InvalidError("an edge type needs an adjacency layout")
        _unique("layout", [a.layout.value for a in self.adj_lists])
        for a in self.adj_lists:
            a.validate()
        for g in self.groups:
            g.validate()
            if any(p.cardinality is not Cardinality.SINGLE for p in g.properties):
                raise InvalidError("edge properties have one value")
        _unique("property", self.property_names)

    def has_layout(self, layout: Layout) -> bool:
        return any(a.layout is layout for a in self.adj_lists)

    def adj_list(self, layout: Layout) -> AdjList:
        for a in self.adj_lists:
            if a.layout is layout:
                return a
        raise MissingKeyError(f"{self.concat()} has no layout {layout.value}")

    def add_adj_list(self, adj: AdjList) -> EdgeInfo:
        if self.has_layout(adj.layout):
            raise InvalidError(f"layout {adj.layout.value} is there already")
        return replace(self, adj_lists=(*self.adj_lists, adj))

    def remove_adj_list(self, layout: Layout) -> EdgeInfo:
        self.adj_list(layout)
        return replace(self, adj_lists=tuple(a for a in self.adj_lists if a.layout is not layout))

    def part_size(self, layout: Layout) -> int:
        """Vertices of the aligned end that share a part."""
        return self.src_chunk_size if layout.by_source else self.dst_chunk_size

    def layout_path(self, layout: Layout) -> str:
        return f"{self.prefix}{self.adj_list(layout).prefix}"

    def vertex_count_path(self, layout: Layout) -> str:
        return f"{self.layout_path(layout)}vertex_count"

    def edge_count_path(self, layout: Layout, part: int) -> str:
        return f"{self.layout_path(layout)}edge_count{part}"

    def offset_path(self, layout: Layout, part: int | None = None) -> str:
        if not layout.ordered:
            raise InvalidError(f"{layout.value} has no offsets")
        return f"{self.layout_path(layout)}offset/" + ("" if part is None else f"chunk{part}")

    def adj_path(self, layout: Layout, part: int | None = None, chunk: int | None = None) -> str:
        return f"{self.layout_path(layout)}adj_list/" + _tail(part, chunk)

    def group_path(self, group: PropertyGroup, layout: Layout, part: int | None = None, chunk: int | None = None) -> str:
        return f"{self.layout_path(layout)}{group.prefix}" + _tail(part, chunk)


def _tail(part: int | None, chunk: int | None) -> str:
    return ("" if part is None else f"part{part}/") + ("" if part is None or chunk is None else f"chunk{chunk}")


@dataclass(frozen=True)
class GraphInfo:
    name: str
    prefix: str = ""
    vertices: tuple[VertexInfo, ...] = ()
    edges: tuple[EdgeInfo, ...] = ()
    labels: tuple[str, ...] = ()
    extra: tuple[tuple[str, str], ...] = ()
    version: Version = field(default_factory=Version)

    def __post_init__(self):
        for name in ("vertices", "edges", "labels"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if isinstance(self.extra, dict):
            object.__setattr__(self, "extra", tuple(self.extra.items()))
        if self.prefix and not self.prefix.endswith("/"):
            object.__setattr__(self, "prefix", self.prefix + "/")

    def validate(self) -> None:
        if not self.name or not self.prefix:
            raise InvalidError("a graph needs a name and a prefix")
        _unique("vertex type", [v.type for v in self.vertices])
        _unique("edge type", [e.key for e in self.edges])
        for x in (*self.vertices, *self.edges):
            x.validate()

    def has_vertex(self, kind: str) -> bool:
        return any(v.type == kind for v in self.vertices)

    def vertex(self, kind: str) -> VertexInfo:
        for v in self.vertices:
            if v.type == kind:
                return v
        raise MissingKeyError(f"no vertex type {kind!r}")

    def has_edge(self, src: str, edge: str, dst: str) -> bool:
        return any(e.key == (src, edge, dst) for e in self.edges)

    def edge(self, src: str, edge: str, dst: str) -> EdgeInfo:
        for e in self.edges:
            if e.key == (src, edge, dst):
                return e
        raise MissingKeyError(f"no edge type {src}-{edge}-{dst}")

    def add_vertex(self, info: VertexInfo) -> GraphInfo:
        if self.has_vertex(info.type):
            raise InvalidError(f"vertex type {info.type!r} is there already")
        return replace(self, vertices=(*self.vertices, info))

    def remove_vertex(self, kind: str) -> GraphInfo:
        self.vertex(kind)
        return replace(self, vertices=tuple(v for v in self.vertices if v.type != kind))

    def add_edge(self, info: EdgeInfo) -> GraphInfo:
        if self.has_edge(*info.key):
            raise InvalidError(f"edge type {info.concat()!r} is there already")
        return replace(self, edges=(*self.edges, info))

    def remove_edge(self, src: str, edge: str, dst: str) -> GraphInfo:
        self.edge(src, edge, dst)
        return replace(self, edges=tuple(e for e in self.edges if e.key != (src, edge, dst)))

    def put_vertex(self, info: VertexInfo) -> GraphInfo:
        """Adds the type, or replaces the one of its name."""
        return replace(self, vertices=(*(v for v in self.vertices if v.type != info.type), info))

    def put_edge(self, info: EdgeInfo) -> GraphInfo:
        return replace(self, edges=(*(e for e in self.edges if e.key != info.key), info))


def infer_vertex(kind: str, schema: T.StructType, primary: str | None = None, chunk_size: int = names.VERTEX_CHUNK_SIZE, file_type: str = names.FILE_TYPE, labels: Iterable[str] = ()) -> VertexInfo:
    """A vertex type of one group from a table's columns; the primary key is the first unless named."""
    reserved = names.renames(schema.names, [names.VERTEX])
    fields = [f for f in schema.fields if f.name not in reserved and f.name != names.LABELS and not f.name.startswith(names.PREFIX)]
    if not fields:
        raise InvalidError("the table has no property")
    primary = primary or fields[0].name
    if primary not in [f.name for f in fields]:
        raise MissingKeyError(f"no column {primary!r}")
    props = tuple(Property(f.name, GType.from_spark(f.dataType), f.name == primary) for f in fields)
    return VertexInfo(kind, chunk_size, (PropertyGroup(props, file_type),), tuple(labels), f"vertex/{kind}/")


def infer_edge(key: tuple[str, str, str], schema: T.StructType, ends: tuple[str, str], sizes: tuple[int, int, int], file_type: str = names.FILE_TYPE, directed: bool = True, layouts: Iterable[Layout] = (Layout.BY_SOURCE, Layout.BY_DEST)) -> EdgeInfo:
    """An edge type from a table's columns without its two ends; sizes: edge, source and destination chunks."""
    reserved = names.renames(schema.names, [names.SRC, names.DST])
    props = tuple(Property(f.name, GType.from_spark(f.dataType)) for f in schema.fields if f.name not in ends and f.name not in reserved and not f.name.startswith(names.PREFIX))
    groups = (PropertyGroup(props, file_type),) if props else ()
    return EdgeInfo(*key, *sizes, directed, tuple(AdjList(x, file_type) for x in layouts), groups, f"edge/{names.SEPARATOR.join(key)}/")
