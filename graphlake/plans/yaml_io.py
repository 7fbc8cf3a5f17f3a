"""Metadata as YAML files: one for the graph, which lists one for each vertex and edge type."""

from __future__ import annotations

from typing import Any

from ..errors import InvalidError, YamlError
from ..functions.types import Cardinality, GType
from .info import AdjList, EdgeInfo, GraphInfo, Layout, Property, PropertyGroup, Version, VertexInfo


def _parse(text: str) -> dict[str, Any]:
    import yaml

    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise YamlError(str(e)) from e
    if not isinstance(found, dict):
        raise YamlError("the file holds no mapping")
    return found


def _dump(tree: dict[str, Any]) -> str:
    import yaml

    return yaml.safe_dump(tree, sort_keys=False, allow_unicode=True)


def _need(tree: dict[str, Any], *keys: str) -> list[Any]:
    if missing := [k for k in keys if k not in tree or tree[k] is None]:
        raise YamlError(f"missing: {missing}")
    return [tree[k] for k in keys]


def _group(tree: dict[str, Any], of_edge: bool) -> PropertyGroup:
    props = []
    for p in tree.get("properties") or []:
        name, kind = _need(p, "name", "data_type")
        cardinality = Cardinality.parse(p.get("cardinality"))
        if of_edge and cardinality is not Cardinality.SINGLE:
            raise YamlError(f"edge property {name!r} has one value only")
        primary = bool(p.get("is_primary", False))
        props.append(Property(str(name), GType.parse(kind), primary, p.get("is_nullable", not primary), cardinality))
    return PropertyGroup(tuple(props), str(tree.get("file_type", "parquet")), tree.get("prefix") or "")


def _group_tree(group: PropertyGroup, of_edge: bool) -> dict[str, Any]:
    props = []
    for p in group.properties:
        own: dict[str, Any] = {"name": p.name, "data_type": str(p.type), "is_primary": p.primary, "is_nullable": bool(p.nullable)}
        if not of_edge and p.cardinality is not Cardinality.SINGLE:
            own["cardinality"] = p.cardinality.value
        props.append(own)
    return {"properties": props, "file_type": group.file_type, "prefix": group.prefix}


def _checked(info):
    try:
        info.validate()
    except InvalidError as e:
        raise YamlError(str(e)) from e
    return info


def load_vertex(text: str) -> VertexInfo:
    tree = _parse(text)
    kind, size = _need(tree, "type", "chunk_size")
    groups = tuple(_group(g, False) for g in tree.get("property_groups") or [])
    return _checked(VertexInfo(str(kind), int(size), groups, tuple(tree.get("labels") or ()), tree.get("prefix") or "", Version.parse(tree.get("version", "gl/v1"))))


def dump_vertex(v: VertexInfo) -> str:
    tree: dict[str, Any] = {"type": v.type, "chunk_size": v.chunk_size, "prefix": v.prefix}
    if v.labels:
        tree["labels"] = list(v.labels)
    return _dump(tree | {"property_groups": [_group_tree(g, False) for g in v.groups], "version": str(v.version)})


def load_edge(text: str) -> EdgeInfo:
    tree = _parse(text)
    src, edge, dst, size, src_size, dst_size = _need(tree, "src_type", "edge_type", "dst_type", "chunk_size", "src_chunk_size", "dst_chunk_size")
    lists = tuple(AdjList(Layout.of(a["ordered"], a["aligned_by"]), a.get("file_type", "parquet"), a.get("prefix") or "") for a in tree.get("adj_lists") or [])
    groups = tuple(_group(g, True) for g in tree.get("property_groups") or [])
    return _checked(EdgeInfo(str(src), str(edge), str(dst), int(size), int(src_size), int(dst_size), bool(tree.get("directed", True)), lists, groups, tree.get("prefix") or "", Version.parse(tree.get("version", "gl/v1"))))


def dump_edge(e: EdgeInfo) -> str:
    tree: dict[str, Any] = {"src_type": e.src_type, "edge_type": e.edge_type, "dst_type": e.dst_type, "chunk_size": e.chunk_size, "src_chunk_size": e.src_chunk_size, "dst_chunk_size": e.dst_chunk_size, "directed": e.directed, "prefix": e.prefix}
    tree["adj_lists"] = [{"ordered": a.layout.ordered, "aligned_by": a.layout.aligned_by, "file_type": a.file_type, "prefix": a.prefix} for a in e.adj_lists]
    return _dump(tree | {"property_groups": [_group_tree(g, True) for g in e.groups], "version": str(e.version)})


def load_graph(text: str, folder: str, read) -> GraphInfo:
    """`folder`: where the file is, and the root of data if the file names none; `read`: gives a text by its path."""
    tree = _parse(text)
    (name,) = _need(tree, "name")
    at = folder if folder.endswith("/") else folder + "/"
    place = lambda f: f if f.startswith("/") or "://" in f else at + f
    prefix = tree.get("prefix") or at
    if prefix.startswith("./") or prefix == ".":
        prefix = at + prefix[2:]
    extra = tree.get("extra_info") or {}
    if isinstance(extra, list):
        extra = {str(x["key"]): str(x["value"]) for x in extra}
    return _checked(
        GraphInfo(
            str(name), prefix, tuple(load_vertex(read(place(f))) for f in tree.get("vertices") or []), tuple(load_edge(read(place(f))) for f in tree.get("edges") or []),
            tuple(tree.get("labels") or ()), tuple((str(k), str(v)) for k, v in extra.items()), Version.parse(tree.get("version", "gl/v1")),
        )
    )


def vertex_file(v: VertexInfo) -> str:
    return f"{v.type}.vertex.yml"


def edge_file(e: EdgeInfo) -> str:
    return f"{e.concat()}.edge.yml"


def graph_file(g: GraphInfo) -> str:
    return f"{g.name}.graph.yml"


def dump_graph(g: GraphInfo) -> str:
    tree: dict[str, Any] = {"name": g.name, "prefix": g.prefix, "vertices": [vertex_file(v) for v in g.vertices], "edges": [edge_file(e) for e in g.edges]}
    if g.labels:
        tree["labels"] = list(g.labels)
    if g.extra:
        tree["extra_info"] = [{"key": k, "value": v} for k, v in g.extra]
    return _dump(tree | {"version": str(g.version)})
