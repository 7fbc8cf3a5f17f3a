"""Import by configuration: source files to a graph with metadata and data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import names
from ..errors import InvalidError, MissingKeyError, YamlError
from ..functions.scalars import split_values
from ..functions.types import Cardinality, GType
from ..operators.index import merge_columns
from ..plans.graph import Graph, GraphWriter
from ..plans.info import FILE_TYPES, AdjList, EdgeInfo, GraphInfo, Layout, Property, PropertyGroup, ValidateLevel, Version, VertexInfo
from .fs import Files

#: Chunk sizes of an import that names none.
VERTEX_CHUNK, EDGE_CHUNK = 100, 1024


@dataclass(frozen=True)
class Source:
    """A file and the columns taken from it: {column in the file: property}."""

    path: str
    columns: dict[str, str]
    file_type: str
    delimiter: str = ","

    @classmethod
    def parse(cls, tree: dict[str, Any]) -> Source:
        path, columns = tree.get("path"), tree.get("columns")
        if not path or not columns:
            raise YamlError("a source needs a path and columns")
        kind = tree.get("file_type") or path.rsplit(".", 1)[-1]
        if kind not in FILE_TYPES:
            raise YamlError(f"no file type for {path!r}")
        delimiter = tree.get("delimiter", ",")
        if len(delimiter) != 1:
            raise YamlError("a delimiter is one character")
        return cls(path, {str(k): str(v) for k, v in columns.items()}, kind, delimiter)

    def read(self, spark: SparkSession) -> DataFrame:
        """The columns under their properties' names. A missing column is an error; in JSON only if none is there."""
        reader = spark.read.format(self.file_type)
        if self.file_type == "csv":
            reader = reader.option("header", True).option("sep", self.delimiter)
        df = reader.load(self.path)
        missing = [c for c in self.columns if c not in df.columns]
        if missing and (self.file_type != "json" or len(missing) == len(self.columns)):
            raise MissingKeyError(f"{self.path} has no columns {missing}")
        return df.select(*((F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")).alias(p) for c, p in self.columns.items()))


def _sources(spark: SparkSession, tree: dict[str, Any], key: str | None) -> DataFrame:
    """All sources side by side: on the key that all have, or by place."""
    tables = [Source.parse(s).read(spark) for s in tree.get("sources") or []]
    if not tables:
        raise YamlError("sources must not be empty")
    keyed = key is not None and all(key in t.columns for t in tables)
    return reduce(lambda a, b: merge_columns(a, b, key if keyed else None), tables)


def _groups(tree: dict[str, Any], file_type: str) -> tuple[PropertyGroup, ...]:
    out = []
    for g in tree.get("property_groups") or []:
        props = []
        for p in g.get("properties") or []:
            primary = bool(p.get("is_primary", False))
            if primary and p.get("nullable"):
                raise YamlError(f"primary key {p['name']!r} must not be nullable")
            props.append(Property(p["name"], GType.parse(p["data_type"]), primary, p.get("nullable", not primary), Cardinality.parse(p.get("cardinality"))))
        if not props:
            raise YamlError("properties must not be empty")
        out.append(PropertyGroup(tuple(props), g.get("file_type") or file_type))
    return tuple(out)


def _typed(df: DataFrame, groups: tuple[PropertyGroup, ...], extra: list[str]) -> DataFrame:
    """Casts to declared types, which fails on values that don't fit; many-valued strings are split on `;`."""
    columns = []
    for g in groups:
        for p in g.properties:
            if p.name not in df.columns:
                raise MissingKeyError(f"no source has the property {p.name!r}")
            own = F.col(f"`{p.name}`")
            if p.cardinality is not Cardinality.SINGLE and df.schema[p.name].dataType.simpleString() == "string":
                own = split_values(own)
            columns.append(own.cast(p.field.dataType).alias(p.name))
    return df.select(*extra, *columns)


def parse_config(tree: dict[str, Any]) -> tuple[GraphInfo, dict[str, dict[str, Any]], dict[tuple[str, str, str], dict[str, Any]]]:
    """Metadata of the graph to be, and the configuration of each type, checked against each other."""
    root = next((tree[k] for k in tree if k not in ("import_schema", "schema") and isinstance(tree[k], dict) and "path" in tree[k]), None)
    schema = tree.get("import_schema") or tree.get("schema")
    if root is None or not isinstance(schema, dict):
        raise YamlError("a configuration needs a graph and an import_schema")
    if not root.get("name"):
        raise YamlError("the graph needs a name")
    kind, layout = root.get("file_type", "parquet"), root.get("adj_list_type", Layout.BY_SOURCE.value)
    vertex_chunk, edge_chunk = int(root.get("vertex_chunk_size") or VERTEX_CHUNK), int(root.get("edge_chunk_size") or EDGE_CHUNK)
    version = Version.parse(root.get("version") or "gl/v1")
    vertices, v_trees = [], {}
    for v in schema.get("vertices") or []:
        groups = _groups(v, kind)
        if not groups:
            raise YamlError("property_groups must not be empty")
        info = VertexInfo(v["type"], int(v.get("chunk_size") or vertex_chunk), groups, tuple(v.get("labels") or ()), v.get("prefix") or f"vertex/{v['type']}/", version)
        if info.primary_key is None:
            raise YamlError(f"vertex type {info.type!r} has no primary key")
        vertices.append(info)
        v_trees[info.type] = v
    sizes = {v.type: v.chunk_size for v in vertices}
    edges, e_trees = [], {}
    for e in schema.get("edges") or []:
        key = (e["src_type"], e["edge_type"], e["dst_type"])
        for end, prop in ((key[0], e["src_prop"]), (key[2], e["dst_prop"])):
            if end not in sizes:
                raise YamlError(f"no vertex type {end!r}")
            if not next(v for v in vertices if v.type == end).has_property(prop):
                raise YamlError(f"vertex type {end!r} has no property {prop!r}")
        lists = tuple(AdjList(Layout.of(a["ordered"], a["aligned_by"]), a.get("file_type") or kind) for a in e.get("adj_lists") or []) or (AdjList(Layout(layout), kind),)
        edges.append(EdgeInfo(*key, int(e.get("chunk_size") or edge_chunk), sizes[key[0]], sizes[key[2]], bool(e.get("directed", True)), lists, _groups(e, kind), e.get("prefix") or f"edge/{names.SEPARATOR.join(key)}/", version))
        e_trees[key] = e
    info = GraphInfo(root["name"], root["path"], tuple(vertices), tuple(edges), version=version)
    info.validate()
    return info, v_trees, e_trees


def load_config(spark: SparkSession | None, path: str) -> dict[str, Any]:
    import yaml

    text = open(path, encoding="utf-8").read() if spark is None else Files(spark).read_text(path)
    tree = yaml.safe_load(text)
    if not isinstance(tree, dict):
        raise YamlError("the file holds no mapping")
    return tree


def import_graph(spark: SparkSession, config: dict[str, Any] | str) -> Graph:
    """Reads the sources, writes data and metadata. Edges to keys that no vertex has are an error, as are repeated keys.

    `src_prop` and `dst_prop` name properties of the end types: if both are the same, the sources' columns are told
    apart by `src` and `dst`, or by their order.
    """
    tree = load_config(spark, config) if isinstance(config, str) else config
    info, v_trees, e_trees = parse_config(tree)
    root = next(x for x in tree.values() if isinstance(x, dict) and "path" in x)
    level = ValidateLevel(root.get("validate_level") or "weak")
    writer = GraphWriter(spark)
    for v in info.vertices:
        df = _sources(spark, v_trees[v.type], v.primary_key)
        extra = [names.LABELS] if names.LABELS in df.columns else []
        df = _typed(df, v.groups, extra)
        if extra and df.schema[names.LABELS].dataType.simpleString() == "string":
            df = df.withColumn(names.LABELS, split_values(F.col(f"`{names.LABELS}`")))
        writer.put_vertices(v.type, df, v.primary_key, v.labels)
    for e in info.edges:
        t = e_trees[e.key]
        renamed = dict(t, sources=[dict(s, columns=_ends(s["columns"], t["src_prop"], t["dst_prop"])) for s in t.get("sources") or []])
        df = _sources(spark, renamed, None)
        if missing := [c for c in ("_src", "_dst") if c not in df.columns]:
            raise InvalidError(f"the sources of {e.concat()} have no {missing}")
        kinds = {"_src": info.vertex(e.src_type).get_property(t["src_prop"]), "_dst": info.vertex(e.dst_type).get_property(t["dst_prop"])}
        df = _typed(df.withColumns({c: F.col(c).cast(p.field.dataType) for c, p in kinds.items()}), e.groups, ["_src", "_dst"])
        writer.put_edges(e.key, df, "_src", "_dst")
    return writer.write(info, level, on_dangling="error")


def _ends(columns: dict[str, str], src: str, dst: str) -> dict[str, str]:
    """The source's columns with its two ends under names of their own."""
    out, left = {}, ["_src", "_dst"]
    for column, prop in columns.items():
        if prop in ("src", "_src") or (prop == src and "_src" in left and not (src == dst and column.lower().startswith("dst"))):
            out[column] = "_src"
        elif prop in ("dst", "_dst") or (prop == dst and "_dst" in left):
            out[column] = "_dst"
        else:
            out[column] = prop
            continue
        left = [x for x in left if x != out[column]]
    return out


def read_edge_list(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """src, dst of a text file of pairs between white space; comments and short lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.ltrim("value").startswith(comment)).select(parts.alias("p")).filter(F.size("p") >= 2)
    return rows.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"))


def import_edge_list(spark: SparkSession, path: str, prefix: str, name: str = "graph", vertex: str = "node", edge: str = "links", vertex_chunk: int = 1024, edge_chunk: int = 1024 * 1024, file_type: str = "csv") -> Graph:
    """A graph whose vertices are the ids of an edge list."""
    from ..operators.index import united_keys

    pairs = read_edge_list(spark, path)
    writer = GraphWriter(spark).put_vertices(vertex, united_keys(pairs, "src", "dst").withColumnRenamed("key", "id"), "id").put_edges((vertex, edge, vertex), pairs, "src", "dst")
    return writer.write(writer.infer(name, prefix, vertex_chunk, edge_chunk, file_type))


def import_delimited(spark: SparkSession, vertices: dict[str, tuple[str, str]], edges: dict[tuple[str, str, str], str], prefix: str, name: str, sep: str = "|", vertex_chunk: int = VERTEX_CHUNK, edge_chunk: int = EDGE_CHUNK, file_type: str = "parquet") -> Graph:
    """A graph from delimited files with headers: vertices {type: (path, key)}, edges {triple: path}, ends in the first two columns."""
    read = lambda p: spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(p)
    writer = GraphWriter(spark)
    for kind, (path, key) in vertices.items():
        writer.put_vertices(kind, read(path), key)
    for key, path in edges.items():
        writer.put_edges(key, read(path))
    return writer.write(writer.infer(name, prefix, vertex_chunk, edge_chunk, file_type))
