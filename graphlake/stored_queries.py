"""Registered queries over stored graphs: chunks, column groups, cursors, elements, builders and imports.

Each writes its graph to the session's shared folder, reads what it is about, keeps the result and removes the graph.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as c
from . import names
from .functions.expressions import Property as P
from .functions.types import Cardinality, GType
from .operators import algorithms as algo
from .operators import index
from .operators.compare import differences
from .plans.graph import Graph, GraphWriter
from .plans.info import AdjList, EdgeInfo, Layout, Property, PropertyGroup, VertexInfo
from .session import cut
from .sources.builders import VertexBuilder
from .sources.connectors import Database, Folder, export_database, import_database
from .sources.cursors import EdgeCursor, OffsetCursor, VertexCursor
from .sources.importer import import_delimited, import_graph
from .sources.reader import EdgeReader, VertexReader
from .sources.writer import EdgeWriter, VertexWriter, install_chunk

V, S, D = names.VERTEX, names.SRC, names.DST
#: Vertices and edges in a chunk of the stored samples.
PART, CHUNK = 100, 256


def register(query: Callable, sql: dict[str, str], ids: Callable[[DataFrame], DataFrame]) -> None:
    """Adds this module's queries; sql: tables of the sample graph as SQL (CID, PLACE, FOLLOW, FATHER, LEVELS)."""
    cid, place = sql["CID"], sql["PLACE"]
    placed = f"(SELECT *, src // {PART} AS part, row_number() OVER (PARTITION BY src // {PART} ORDER BY src, dst) - 1 AS pos, row_number() OVER (ORDER BY src, dst) - 1 AS edge FROM {place})"

    def two_groups(spark: SparkSession, d: str, path: str) -> Graph:
        """Customers and their orders; the edges have one column group in Parquet and one in ORC."""
        writer = GraphWriter(spark).put_vertices("customer", c.customers(spark, d), "c_custkey", c.SEGMENTS)
        writer.put_vertices("orders", c.table(spark, d, "orders").select("o_orderkey"), "o_orderkey").put_edges(c.PLACES, c.places(spark, d), "o_custkey", "o_orderkey")
        info = writer.infer("two", path, PART, CHUNK, layouts=(Layout.BY_SOURCE,))
        edge = info.edges[0]
        price, day = edge.groups[0].properties
        groups = (PropertyGroup((price,), "parquet"), PropertyGroup((day,), "orc"))
        return writer.write(replace(info, edges=(replace(edge, groups=groups),)))

    def stored(name: str, text: str, with_edges: bool = True):
        def add(read: Callable[[Graph], DataFrame]) -> None:
            def run(spark: SparkSession, d: str) -> DataFrame:
                with c.workspace(spark) as path:
                    g = two_groups(spark, d, path) if with_edges else c.store(spark, d, path, vertex_chunk=PART, with_edges=False)
                    return cut(ids(read(g)))

            query(name, text)(run)

        return add

    def rows(g: Graph, values: list[tuple], schema: str) -> DataFrame:
        return g.spark.createDataFrame(values, schema)

    def edges(g: Graph) -> EdgeReader:
        return g.edge_reader(c.PLACES, Layout.BY_SOURCE)

    def chunk_counts(g: Graph, reader: EdgeReader) -> DataFrame:
        return rows(g, [(p, n, reader.count(p)) for p, n in enumerate(reader.chunk_counts()) if n], "part long, chunks long, n long")

    # ---- chunks and column groups

    stored("edge_adj_chunk", f"SELECT src, dst FROM {placed} WHERE part = 0 AND pos // {CHUNK} = 1")(lambda g: edges(g).adj_chunk(0, 1))
    stored("edge_group_chunk", f"SELECT o_totalprice FROM {placed} WHERE part = 0 AND pos // {CHUNK} = 1")(lambda g: edges(g).group_chunk(edges(g).info.groups[0], 0, 1))
    stored("edge_group_part", f"SELECT edge, o_orderdate FROM {placed} WHERE part = 1")(lambda g: edges(g).group(edges(g).info.groups[1], 1))
    stored("edge_group_all", f"SELECT edge, o_totalprice FROM {placed}")(lambda g: edges(g).group(edges(g).info.groups[0]))
    stored("edge_groups_part", f"SELECT edge, o_totalprice, o_orderdate FROM {placed} WHERE part = 1")(lambda g: edges(g).groups(list(edges(g).info.groups), 1))
    stored("edge_groups_all", f"SELECT edge, o_orderdate, o_totalprice FROM {placed}")(lambda g: edges(g).groups(list(reversed(edges(g).info.groups))))
    stored("edge_all_groups", f"SELECT o_totalprice, o_orderdate FROM {placed}")(lambda g: edges(g).all_groups(add_index=False))
    stored("edges_two_groups", f"SELECT edge, src, dst, o_totalprice, o_orderdate FROM {placed}")(lambda g: edges(g).edges())
    stored("vertex_chunk_scan", f"SELECT id, c_custkey, c_name FROM {cid} WHERE id // {PART} = 1", False)(
        lambda g: g.vertex_reader("customer").chunk(g.info.vertex("customer").groups[0], 1).select(V, "c_custkey", "c_name")
    )
    stored("vertex_chunk_count", f"SELECT (count(*) + {PART - 1}) // {PART} AS chunks, count(*) AS n FROM customer", False)(
        lambda g: rows(g, [(g.vertex_reader("customer").chunk_count(), g.vertex_reader("customer").count())], "chunks long, n long")
    )
    stored("edge_chunk_counts", f"SELECT part, count(DISTINCT pos // {CHUNK}) AS chunks, count(*) AS n FROM {placed} GROUP BY 1")(
        lambda g: chunk_counts(g, edges(g))
    )

    # ---- cursors

    def vertex_cursor(g: Graph) -> DataFrame:
        cursor = VertexCursor.for_properties(g.vertex_reader("customer"), ["c_name", "c_acctbal"], P("c_acctbal") > 0.0)
        cursor.seek(30)
        cursor.next_chunk()
        cursor.seek(PART + 20)
        return cursor.get()

    stored("cursor_vertices", f"SELECT id, c_name, c_acctbal FROM {cid} WHERE id BETWEEN {PART + 20} AND {2 * PART - 1} AND c_acctbal > 0", False)(vertex_cursor)

    def label_cursor(g: Graph) -> DataFrame:
        cursor = VertexCursor(g.vertex_reader("customer"), None, ["BUILDING", "MACHINERY"])
        cursor.seek(PART + 5)
        return cursor.get()

    stored("cursor_labels", f"SELECT id, c_mktsegment = 'BUILDING' AS \"BUILDING\", c_mktsegment = 'MACHINERY' AS \"MACHINERY\" FROM {cid} WHERE id BETWEEN {PART + 5} AND {2 * PART - 1}", False)(label_cursor)

    def adj_cursor(g: Graph) -> DataFrame:
        cursor = EdgeCursor(edges(g))
        cursor.seek_src(40)
        return cursor.get()

    before = f"(SELECT count(*) FROM {place} WHERE src < 40)"
    stored("cursor_adjacency", f"SELECT src, dst FROM {placed} WHERE part = 0 AND pos >= {before} AND pos // {CHUNK} = {before} // {CHUNK}")(adj_cursor)

    def property_cursor(g: Graph) -> DataFrame:
        cursor = EdgeCursor(edges(g), edges(g).info.groups[1])
        cursor.seek(CHUNK + 44)
        return cursor.get()

    stored("cursor_edge_properties", f"SELECT o_orderdate FROM {placed} WHERE part = 0 AND pos BETWEEN {CHUNK + 44} AND {2 * CHUNK - 1}")(property_cursor)

    def offset_cursor(g: Graph) -> DataFrame:
        cursor = OffsetCursor(edges(g))
        cursor.seek(20)
        return cursor.get()

    stored("cursor_offsets", f"SELECT p.place, (SELECT count(*) FROM {place} WHERE src < p.place) AS \"offset\" FROM (SELECT unnest(range(20, {PART + 1})) AS place) p")(offset_cursor)

    def walk(g: Graph) -> DataFrame:
        """All chunks in turn, with their paths below the root."""
        cursor, found = EdgeCursor(edges(g)), []
        while True:
            found.append((cursor.part, cursor.chunk_number, cursor.rows_in_chunk(), cursor.path().removeprefix(cursor.reader.prefix)))
            if not cursor.next_chunk():
                return rows(g, found, "part long, chunk long, rows long, path string")

    below = "'edge/customer_places_orders/ordered_by_source/adj_list/part' || part || '/chunk' || (pos // " + str(CHUNK) + ")"
    stored("cursor_walk", f"SELECT part, pos // {CHUNK} AS chunk, count(*) AS rows, {below} AS path FROM {placed} GROUP BY ALL")(walk)

    # ---- elements

    stored("vertex_find", f"SELECT id, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {cid} WHERE id = 42", False)(
        lambda g: g.spark.createDataFrame([g.vertices("customer").find(42).row], g.vertices("customer").table().select(V, "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").schema)
    )
    stored("vertex_iterate", f"SELECT id, c_custkey AS key, c_name IS NOT NULL AS has_name FROM {cid} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000", False)(
        lambda g: rows(g, [(v.id, v.property("c_custkey"), v.is_valid("c_name")) for v in g.vertices("customer").with_label("BUILDING").with_property(P("c_acctbal") > 5000.0)], "id long, key long, has_name boolean")
    )
    stored("vertex_labels_of", f"SELECT id, [c_mktsegment] AS labels, c_mktsegment = 'BUILDING' AS building FROM {cid} WHERE id IN (3, 50, 149)", False)(
        lambda g: rows(g, [(v.id, v.labels(), v.has_label("BUILDING")) for v in map(g.vertices("customer").find, (3, 50, 149))], "id long, labels array<string>, building boolean")
    )
    stored("edge_iterate", f"SELECT src, dst, o_totalprice AS price, true AS has_price FROM {place} WHERE src < {PART}")(
        lambda g: rows(g, [(e.source, e.destination, e.property("o_totalprice"), e.is_valid("o_totalprice")) for e in g.edges(c.PLACES).between(0, 1)], "src long, dst long, price double, has_price boolean")
    )
    stored("graph_read_labels", f"SELECT id, c_custkey, [c_mktsegment] AS labels FROM {cid}", False)(lambda g: g.tables()[0]["customer"].select(V, "c_custkey", F.col(f"`{names.LABELS}`").alias("labels")))

    # ---- layouts and names

    @query("edges_loose_by_dest", f"SELECT src, dst FROM {place} WHERE dst // {PART} = 1")
    def edges_loose_by_dest(spark, d):
        with c.workspace(spark) as path:
            g = c.store(spark, d, path, layouts=(Layout.LOOSE_BY_DEST,), vertex_chunk=PART, edge_chunk=CHUNK)
            return ids(cut(g.edge_reader(c.PLACES, Layout.LOOSE_BY_DEST).edges(1, add_index=False, columns=[])))

    clash = {"chunk": "int64", "part": "string", "position": "double", "row": "int64", "place": "int64", "s": "string", "d": "int64", "_key": "int64", "_part": "int64", "_isPrimary": "int64"}

    def clashing(df: DataFrame, key: str, text: str, number: str) -> list:
        values = {"string": F.col(text), "double": F.col(number).cast("double"), "int64": F.col(key).cast("long")}
        return [(values[t] if t != "int64" else values[t] + i).alias(n) for i, (n, t) in enumerate(clash.items())]

    said = lambda key, text, number: ", ".join(f"{text if t == 'string' else number if t == 'double' else f'{key} + {i}'} AS \"{n}\"" for i, (n, t) in enumerate(clash.items()))

    for kind in ("parquet", "orc", "csv", "json"):

        @query(f"rt_clashing_names_{kind}", f"SELECT 'vertex' AS what, id AS a, id AS b, {said('c_custkey', 'c_name', 'c_acctbal')} FROM {cid} UNION ALL SELECT 'edge', p.src, p.dst, {said('c_custkey', 'c_name', 'o_totalprice')} FROM {place} p JOIN {cid} v ON v.id = p.src")
        def rt_clashing_names(spark, d, kind=kind):
            """Properties under names that helper columns, or other archives' reserved columns, might have."""
            people = c.table(spark, d, "customer")
            vertices = people.select("c_custkey", *clashing(people, "c_custkey", "c_name", "c_acctbal"))
            bought = c.places(spark, d).join(people, F.col("o_custkey") == F.col("c_custkey"))
            props = tuple(Property(n, GType.parse(t)) for n, t in clash.items())
            group = PropertyGroup((Property("c_custkey", GType.parse("int64"), True), *props), kind)
            v_info = VertexInfo("customer", PART, (group,), prefix="vertex/customer/")
            e_info = EdgeInfo(*c.PLACES, CHUNK, PART, PART, True, (AdjList(Layout.BY_SOURCE, kind),), (PropertyGroup(props, kind),), "edge/places/")
            with c.workspace(spark) as path:
                writer = VertexWriter(path, v_info, vertices)
                writer.write()
                keyed = bought.select("o_custkey", "o_orderkey", *clashing(bought, "c_custkey", "c_name", "o_totalprice"))
                found = index.both_indexes(keyed, c.customer_map(spark, d), c.order_map(spark, d), "o_custkey", "o_orderkey")
                EdgeWriter(path, e_info, Layout.BY_SOURCE, writer.count, found).write()
                a = VertexReader(spark, path, v_info).all().select(F.lit("vertex").alias("what"), F.col(V).alias("a"), F.col(V).alias("b"), *(f"`{n}`" for n in clash))
                b = EdgeReader(spark, path, e_info, Layout.BY_SOURCE).edges(add_index=False).select(F.lit("edge").alias("what"), F.col(S).alias("a"), F.col(D).alias("b"), *(f"`{n}`" for n in clash))
                return cut(a.unionByName(b))

    @query("null_property", f"SELECT v.id FROM {cid} v LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o.o_custkey = v.c_custkey WHERE n IS NULL")
    def null_property(spark, d):
        """Vertices whose stored property has no value."""
        urgent = c.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
        df = c.table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left")
        info = VertexInfo("customer", PART, (PropertyGroup((Property("c_custkey", GType.parse("int64"), True), Property("n", GType.parse("int64")))),), prefix="vertex/customer/")
        with c.workspace(spark) as path:
            VertexWriter(path, info, df).write()
            return ids(cut(VertexReader(spark, path, info).select(["n"]).filter(F.col("n").isNull()).select(V)))

    @query("index_with_mapping", f"SELECT id, c_name AS name, c_custkey AS key FROM {cid}")
    def index_with_mapping(spark, d):
        indexed, mapping = index.index_with_mapping(c.table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
        return ids(indexed.join(mapping, V).select(V, F.col("c_name").alias("name"), F.col(names.PRIMARY).alias("key")))

    @query("table_differences", "SELECT c_custkey AS key, 'left' AS side FROM customer WHERE c_acctbal > 0 AND c_nationkey >= 10 UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_acctbal <= 0 AND c_nationkey < 10")
    def table_differences(spark, d):
        df = c.table(spark, d, "customer")
        return differences(df.filter("c_acctbal > 0").select(F.col("c_custkey").alias("key")), df.filter("c_nationkey < 10").select(F.col("c_custkey").alias("key")))

    # ---- builders, chunks put in place, imports

    prop = lambda n, t, primary=False: Property(n, GType.parse(t), primary)

    @query("builder_append", "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS id, r_regionkey::BIGINT AS key, r_name AS name FROM region UNION ALL SELECT (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_nationkey) - 1, n_nationkey::BIGINT, n_name FROM nation")
    def builder_append(spark, d):
        """Vertices built row by row, and more of them appended from the start of a chunk."""
        info = VertexInfo("place", 5, (PropertyGroup((prop("key", "int64", True), prop("name", "string"))),), prefix="vertex/place/")
        with c.workspace(spark) as path:
            for name, start in (("region", 0), ("nation", 5)):
                builder = VertexBuilder(spark, path, info, start)
                for row in c.table(spark, d, name).orderBy(f"{name[0]}_{name}key").collect():
                    builder.add({"key": row[f"{name[0]}_{name}key"], "name": row[f"{name[0]}_name"]})
                builder.dump()
            return ids(cut(VertexReader(spark, path, info).all()))

    @query("install_chunks", f"SELECT id, c_custkey FROM {cid} WHERE id < {PART}")
    def install_chunks(spark, d):
        """A chunk of one graph put in its place in another."""
        with c.workspace(spark) as path, c.workspace(spark) as other:
            g = c.store(spark, d, path, vertex_chunk=PART, with_edges=False)
            info = g.info.vertex("customer")
            install_chunk(spark, path + info.chunk_path(info.groups[0], 0), other + info.chunk_path(info.groups[0], 0))
            return ids(cut(VertexReader(spark, other, info).group(info.groups[0], ["c_custkey"])))

    def declared(name: str, kind: str, **more: Any) -> dict[str, Any]:
        return {"name": name, "data_type": kind, **more}

    @query("import_formats", f"SELECT id, c_custkey, c_name, c_acctbal, [c_mktsegment, c_nationkey::VARCHAR] AS tags FROM {cid}")
    def import_formats(spark, d):
        """One vertex type from a delimited, an ORC and a JSON file side by side, with a set split on `;`, strongly checked."""
        df = c.table(spark, d, "customer")
        with c.workspace(spark) as path:
            tags = F.concat_ws(";", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags")
            df.select("c_custkey", tags).write.option("header", True).option("sep", "|").csv(f"{path}a")
            df.select("c_custkey", "c_name").write.orc(f"{path}b")
            df.select("c_custkey", "c_acctbal").write.json(f"{path}c")
            source = lambda at, kind, *own, **more: {"path": path + at, "file_type": kind, "columns": {x: x for x in ("c_custkey", *own)}, **more}
            group = [declared("c_custkey", "int64", is_primary=True), declared("c_name", "string"), declared("c_acctbal", "double"), declared("tags", "string", cardinality=Cardinality.SET.value)]
            g = import_graph(spark, {
                "graph": {"path": f"{path}g/", "name": "shop", "vertex_chunk_size": PART, "validate_level": "strong"},
                "import_schema": {"vertices": [{"type": "customer", "property_groups": [{"properties": group}], "sources": [source("a", "csv", "tags", delimiter="|"), source("b", "orc", "c_name"), source("c", "json", "c_acctbal")]}]},
            })
            return ids(cut(g.vertices("customer").table()))

    @query("import_delimited_files", f"SELECT src, dst FROM {place}")
    def import_delimited_files(spark, d):
        with c.workspace(spark) as path:
            for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey")):
                c.table(spark, d, name).select(key).write.option("header", True).option("sep", "|").csv(path + name)
            c.places(spark, d).select("o_custkey", "o_orderkey").write.option("header", True).option("sep", "|").csv(f"{path}places")
            g = import_delimited(spark, {"customer": (f"{path}customer", "c_custkey"), "orders": (f"{path}orders", "o_orderkey")}, {c.PLACES: f"{path}places"}, f"{path}g/", "shop", vertex_chunk=500, edge_chunk=2_000)
            return ids(cut(g.edge_reader(c.PLACES).edges(add_index=False, columns=[])))

    @query("database_round_trip", f"SELECT o_custkey AS src, o_orderkey AS dst, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey")
    def database_round_trip(spark, d):
        """A graph imported from a database and exported to another, edges under the keys of their ends; folders stand in for both."""
        with c.workspace(spark) as path:
            c.table(spark, d, "customer").select("c_custkey", "c_name").write.parquet(f"{path}a/customer")
            c.table(spark, d, "orders").select("o_orderkey").write.parquet(f"{path}a/orders")
            c.places(spark, d).select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), "o_totalprice").write.parquet(f"{path}a/customer_places_orders")
            g = import_database(Folder(spark, f"{path}a"), {
                "graph": {"path": f"{path}g/", "name": "shop", "vertexChunkSize": 500, "edgeChunkSize": 2_000},
                "schema": {
                    "vertices": [{"label": "customer", "properties": ["c_custkey", "c_name"], "primary": "c_custkey"}, {"label": "orders", "properties": ["o_orderkey"], "primary": "o_orderkey"}],
                    "edges": [{"srcLabel": "customer", "label": "places", "dstLabel": "orders", "srcProp": "c_custkey", "dstProp": "o_orderkey", "properties": ["o_totalprice"]}],
                },
            })
            export_database(g, Folder(spark, f"{path}b"))
            return cut(spark.read.parquet(f"{path}b/customer_places_orders"))

    @query("database_tables", "SELECT DISTINCT o_custkey AS src, o_orderkey AS dst, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice >= 150000")
    def database_tables(spark, d):
        """Vertices and edges written to a relational database, twice, and edges read back in parts by a filter that it applies."""
        with c.workspace(spark) as path, c.database(spark, path) as url:
            db = Database(spark, url)
            for _ in range(2):
                db.write_vertices(c.table(spark, d, "customer").select("c_custkey", "c_name"), "customer", "c_custkey")
                db.write_edges(c.places(spark, d).select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), "o_totalprice"), *c.PLACES, "c_custkey", "o_orderkey")
            known = db.read_vertices("customer", ["c_custkey"]).withColumnRenamed("c_custkey", "src")
            return cut(db.read_edges(*c.PLACES, "c_custkey", "o_orderkey", ["o_totalprice"]).filter("o_totalprice >= 150000").join(known, "src").select("src", "dst", "o_totalprice"))

    # ---- analytics over stored layouts

    def follow_graph(spark: SparkSession, d: str, path: str) -> Graph:
        """Customers and whom they follow, unordered."""
        writer = GraphWriter(spark).put_vertices("customer", c.table(spark, d, "customer").select("c_custkey"), "c_custkey").put_edges(c.FOLLOWS, c.follows(spark, d))
        return writer.write(writer.infer("follows", path, 500, 2_000, layouts=(Layout.LOOSE_BY_SOURCE,)))

    def over_coo(name: str, text: str, run: Callable[[DataFrame, int], DataFrame]) -> None:
        def whole(spark: SparkSession, d: str) -> DataFrame:
            with c.workspace(spark) as path:
                g = follow_graph(spark, d, path)
                return cut(ids(run(g.edge_reader(c.FOLLOWS).edges(add_index=False), g.vertices("customer").count())))

        query(name, text)(whole)

    over_coo("bfs_over_coo", sql["BFS"], lambda e, n: algo.bfs(e, n))
    over_coo("wcc_over_coo", sql["WCC"] + " SELECT id, component FROM w", lambda e, n: algo.weak_components(e, n))

    @query("bfs_tree_stored", f"SELECT a.c_custkey AS father, b.c_custkey AS child FROM ({sql['FATHER']}) t JOIN {cid} a ON a.id = t.father JOIN {cid} b ON b.id = t.id WHERE t.father >= 0 AND t.father <> t.id")
    def bfs_tree_stored(spark, d):
        """The BFS tree written as an edge type of its own and read back with the keys of both ends."""
        key = ("customer", "found", "customer")
        with c.workspace(spark) as path, c.workspace(spark) as other:
            g = follow_graph(spark, d, path)
            people = g.vertices("customer").table()
            tree = cut(algo.bfs_tree(g.edge_reader(c.FOLLOWS).edges(add_index=False), g.vertices("customer").count()))
            writer = GraphWriter(spark).put_vertices("customer", people, "c_custkey").put_edges(key, tree)
            out = writer.write(writer.infer("tree", other, 500, 2_000, layouts=(Layout.BY_SOURCE,)))
            mapping = index.mapping_of(out.vertices("customer").table(), "c_custkey")
            return cut(index.to_primary_keys(out.edge_reader(key).edges(add_index=False), mapping, mapping, "father", "child"))
