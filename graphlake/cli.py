"""Command line: show, check and import graphs. `python -m graphlake.cli --help`."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import __version__
from .errors import GraphError
from .plans import yaml_io
from .plans.info import GraphInfo, Layout

#: The order in which layouts are tried for a count of edges.
COUNT_ORDER = (Layout.BY_DEST, Layout.BY_SOURCE, Layout.LOOSE_BY_DEST, Layout.LOOSE_BY_SOURCE)


def _read(path: str) -> str:
    """A text of any store: names with a scheme are read through Spark's file systems."""
    if "://" in path:
        from .sources.fs import Files

        return Files(_spark()).read_text(path)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _info(path: str) -> GraphInfo:
    return yaml_io.load_graph(_read(path), path.rsplit("/", 1)[0] if "/" in path else ".", _read)


def _spark() -> SparkSession:
    return SparkSession.builder.appName("graphlake").getOrCreate()


def show(path: str, vertex: str | None = None, edge: tuple[str, str, str] | None = None, spark: Callable[[], SparkSession] = _spark) -> str:
    """Metadata of a graph, or of one type with its number of rows."""
    info = _info(path)
    if vertex:
        from .sources.reader import VertexReader

        v = info.vertex(vertex)
        return f"Vertex count: {VertexReader(spark(), info.prefix, v).count()}\n{yaml_io.dump_vertex(v)}"
    if edge:
        from .sources.reader import EdgeReader

        e = info.edge(*edge)
        layout = next(x for x in COUNT_ORDER if e.has_layout(x))
        return f"Edge count: {EdgeReader(spark(), info.prefix, e, layout).count()}\n{yaml_io.dump_edge(e)}"
    return yaml_io.dump_graph(info)


def check(path: str, data: bool = False, shown: int = 20) -> str:
    """Says that the metadata is valid and, if asked for, that the files are as it says; else raises with the first faults."""
    info = _info(path)
    info.validate()
    said = f"{info.name}: {len(info.vertices)} vertex types, {len(info.edges)} edge types, valid"
    if data:
        from .operators.verify import faults
        from .plans.graph import Graph

        if found := faults(Graph.load(_spark(), path)).limit(shown + 1).collect():
            raise GraphError("\n".join(["the files have faults:", *(f"{r['what']} of {r['type']}, part {r['part']}, chunk {r['chunk']}: {r['found']}, not {r['expected']}" for r in found[:shown]), *(["and more"] if len(found) > shown else [])]))
        said += ", files sound"
    return said


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphlake", description=__doc__)
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("show", help="show the metadata")
    one.add_argument("-p", "--path", required=True)
    one.add_argument("-v", "--vertex")
    one.add_argument("-es", "--edge-src")
    one.add_argument("-e", "--edge")
    one.add_argument("-ed", "--edge-dst")
    one = commands.add_parser("check", help="check the metadata, and the files")
    one.add_argument("-p", "--path", required=True)
    one.add_argument("--data", action="store_true", help="read the files too")
    commands.add_parser("import", help="import data").add_argument("-c", "--config", required=True)
    args = parser.parse_args(argv)
    try:
        if args.command == "show":
            edge = (args.edge_src, args.edge, args.edge_dst)
            if any(edge) and not all(edge):
                raise GraphError("an edge type needs its source, its name and its destination")
            print(show(args.path, args.vertex, edge if all(edge) else None))
        elif args.command == "check":
            print(check(args.path, args.data))
        else:
            from .sources.importer import import_graph, load_config

            graph = import_graph(_spark(), load_config(_spark() if "://" in args.config else None, args.config))
            print(f"imported {graph.info.name}: {len(graph.info.vertices)} vertex types, {len(graph.info.edges)} edge types")
    except (GraphError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
