"""Registered queries over stored graphs that read little of them: expansion through offsets, pruned chains of filters, bitmaps of labels.

And over ones that grow or are checked: appended edges, planted faults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as c
from . import names
from .functions.expressions import Property as P
from .operators import expansion, labels, verify
from .plans.graph import Graph, GraphWriter
from .plans.info import Layout
from .session import cut
from .sources import datasource
from .sources.fs import Files

V = names.VERTEX
#: Vertices and edges in a chunk of the stored samples.
PART, CHUNK = 100, 256


def register(query: Callable, sql: dict[str, str], ids: Callable[[DataFrame], DataFrame]) -> None:
    """Adds this module's queries; sql: tables of the sample graph as SQL (CID, PLACE, FOLLOW, LEVELS)."""
    cid, place, follow = sql["CID"], sql["PLACE"], sql["FOLLOW"]

    def over(name: str, text: str, store: Callable[[SparkSession, str, str], Graph]) -> Callable:
        """Registers a query that stores a graph, reads it, and keeps what was read."""

        def add(read: Callable[[Graph], DataFrame]) -> None:
            def run(spark: SparkSession, d: str) -> DataFrame:
                with c.workspace(spark) as path:
                    return cut(ids(read(store(spark, d, path))))

            query(name, text)(run)

        return add

    def shop(*layouts: Layout, part: int = PART) -> Callable[[SparkSession, str, str], Graph]:
        return lambda spark, d, path: c.store(spark, d, path, layouts=layouts, vertex_chunk=part, edge_chunk=CHUNK, with_edges=bool(layouts))

    def followers(spark: SparkSession, d: str, path: str) -> Graph:
        writer = GraphWriter(spark).put_vertices("customer", c.customers(spark, d), "c_custkey", c.SEGMENTS).put_edges(c.FOLLOWS, c.follows(spark, d))
        return writer.write(writer.infer("follows", path, PART, CHUNK, layouts=(Layout.BY_SOURCE,)))

    # ---- expansion through offsets

    rich = "c_mktsegment = 'BUILDING' AND c_acctbal > 9000"
    over("frontier_expansion", f"SELECT p.src, p.dst, p.o_totalprice FROM {place} p JOIN {cid} v ON v.id = p.src WHERE {rich}", shop(Layout.BY_SOURCE))(
        lambda g: g.edges(c.PLACES, Layout.BY_SOURCE).at(g.vertices("customer").with_label("BUILDING").with_property(P("c_acctbal") > 9000.0), ["o_totalprice"])
    )
    over("frontier_expansion_in", f"SELECT src, dst, o_orderdate FROM {place} WHERE o_totalprice > 300000", shop(Layout.BY_DEST, part=500))(
        lambda g: g.edges(c.PLACES, Layout.BY_DEST).at(g.vertices("orders").with_property(P("o_totalprice") > 300000.0), ["o_orderdate"])
    )
    twice = f"SELECT DISTINCT b.dst AS id FROM {follow} a JOIN {follow} b ON b.src = a.dst JOIN {cid} v ON v.id = a.src WHERE v.{rich}"
    over("hops_through_offsets", twice, followers)(
        lambda g: expansion.hops(g.edge_reader(c.FOLLOWS), g.vertices("customer").with_label("BUILDING").with_property(P("c_acctbal") > 9000.0).ids(), 2)
    )
    over("bfs_through_offsets", sql["LEVELS"] + " SELECT id, distance::INTEGER AS distance FROM s", followers)(
        lambda g: expansion.search(g.edge_reader(c.FOLLOWS), g.vertices("customer").ids().filter(F.col(V) == 0))
    )

    # ---- chains of filters that skip chunks

    over("filters_skip_chunks", f"SELECT id, c_name FROM {cid} WHERE c_custkey < 350 AND c_mktsegment = 'BUILDING' AND c_acctbal > 0", shop())(
        lambda g: g.vertices("customer").with_property(P("c_custkey") < 350).narrow().with_label("BUILDING").narrow().with_property(P("c_acctbal") > 0.0).table(["c_name"])
    )

    # ---- bitmaps of labels

    def marked(spark: SparkSession, d: str, path: str) -> Graph:
        """Customers labelled by segment and, some, as rich or indebted; bitmaps beside the labels."""
        more = F.array_compact(F.array(F.when(F.col("c_acctbal") > 5000, F.lit("RICH")), F.when(F.col("c_acctbal") < 0, F.lit("INDEBTED"))))
        people = c.customers(spark, d).withColumn(names.LABELS, F.concat(F.col(f"`{names.LABELS}`"), more))
        writer = GraphWriter(spark).put_vertices("customer", people, "c_custkey", (*c.SEGMENTS, "RICH", "INDEBTED", "NOBODY"))
        return writer.write(writer.infer("marked", path, 500), label_bitmaps=True)

    over("label_bitmap_and", f"SELECT id FROM {cid} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000", marked)(lambda g: g.vertices("customer").with_label("BUILDING", "RICH").ids())
    over("label_bitmap_or", f"SELECT id FROM {cid} WHERE c_mktsegment = 'MACHINERY' OR c_acctbal < 0", marked)(lambda g: g.vertices("customer").with_any_label("MACHINERY", "INDEBTED"))
    held = "SELECT unnest([c_mktsegment, CASE WHEN c_acctbal > 5000 THEN 'RICH' WHEN c_acctbal < 0 THEN 'INDEBTED' END]) AS label FROM customer"
    over("label_bitmap_count", f"SELECT label, count(*) FILTER (here) AS n FROM (SELECT label, true AS here FROM ({held}) WHERE label IS NOT NULL UNION ALL SELECT unnest([{', '.join(repr(x) for x in (*c.SEGMENTS, 'RICH', 'INDEBTED', 'NOBODY'))}]), false) GROUP BY 1", marked)(
        lambda g: labels.bitmap_counts(g.vertex_reader("customer").label_bitmaps(), list(g.info.vertex("customer").labels))
    )

    # ---- encodings

    @query("rt_edges_encoded", f"SELECT src, dst, o_totalprice, o_orderdate FROM {place}")
    def rt_edges_encoded(spark, d):
        """Ids as differences, read back from files as another session finds them by their metadata."""
        with c.workspace(spark) as path:
            writer = GraphWriter(spark).put_vertices("customer", c.customers(spark, d), "c_custkey", c.SEGMENTS).put_vertices("orders", c.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
            writer.put_edges(c.PLACES, c.places(spark, d), "o_custkey", "o_orderkey")
            writer.write(writer.infer("encoded", path, 500, 2_000, layouts=(Layout.BY_SOURCE,)), encoded=True, options={"parquet": {"compression": "snappy"}})
            return cut(ids(Graph.load(spark, f"{path}encoded.graph.yml").edge_reader(c.PLACES).edges(add_index=False)))

    # ---- edges that are appended

    def grown(*layouts: Layout) -> Callable[[SparkSession, str, str], Graph]:
        """The shop with the orders of later years appended in two batches, the second of them twice."""

        def store(spark: SparkSession, d: str, path: str) -> Graph:
            writer = GraphWriter(spark).put_vertices("customer", c.customers(spark, d), "c_custkey", c.SEGMENTS).put_vertices("orders", c.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
            bought = c.places(spark, d)
            year = F.year("o_orderdate")
            writer.put_edges(c.PLACES, bought.filter(year < 1996), "o_custkey", "o_orderkey")
            g = writer.write(writer.infer("grown", path, 500, 1_000, layouts=layouts))
            for batch, rows in ((1, bought.filter(year == 1996)), (2, bought.filter(year > 1996)), (2, bought.filter(year > 1996))):
                g.append_edges(c.PLACES, rows, batch)
            return g

        return store

    over("edges_append", f"SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge, src, dst, o_totalprice, o_orderdate FROM {place}", grown(Layout.BY_SOURCE))(lambda g: g.edge_reader(c.PLACES).edges())
    places_of = "(SELECT part, place FROM (SELECT unnest(range(((SELECT count(*) FROM customer) + 499) // 500)) AS part), (SELECT unnest(range(501)) AS place))"
    over("edges_append_offsets", f"SELECT q.part, q.place, count(p.src) AS \"offset\" FROM {places_of} q LEFT JOIN {place} p ON p.src // 500 = q.part AND p.src % 500 < q.place GROUP BY ALL", grown(Layout.BY_SOURCE))(lambda g: g.edge_reader(c.PLACES).all_offsets())

    # ---- as a data source

    def source(g: Graph, **options: str) -> DataFrame:
        datasource.register(g.spark)
        return g.spark.read.format(datasource.NAME).options(**options).load(f"{g.info.prefix}{g.info.name}.graph.yml")

    over("datasource_edges", f"SELECT src, dst, o_orderdate, o_totalprice FROM {place} WHERE src >= {PART + 50}", shop(Layout.BY_SOURCE))(
        lambda g: source(g, edge=",".join(c.PLACES), layout=Layout.BY_SOURCE.value).filter(F.col(names.SRC) >= PART + 50)
    )
    over("datasource_vertices", f"SELECT id, c_name, c_acctbal FROM {cid} WHERE id < {PART} AND c_name > 'Customer#00000005'", shop())(
        lambda g: source(g, vertex="customer", columns="c_name,c_acctbal").filter((F.col(V) < PART) & (F.col("c_name") > "Customer#00000005"))
    )

    # ---- faults

    def faulty(spark: SparkSession, d: str, path: str) -> Graph:
        """The shop with an edge to no order, a count and an offset that are wrong, and one order too many in the count."""
        orders, key = c.table(spark, d, "orders"), names.hidden("key")
        bought = c.place_ids(spark, d).select(names.SRC, names.DST)
        stray = spark.createDataFrame([(3, orders.count() + 7)], bought.schema)
        writer = GraphWriter(spark).put_vertices("customer", c.customers(spark, d), "c_custkey", c.SEGMENTS).put_vertices("orders", orders.select("o_orderkey"), "o_orderkey").put_edges(c.PLACES, bought.union(stray))
        g = writer.write(writer.infer("faulty", path, PART, CHUNK, layouts=(Layout.BY_SOURCE,)))
        reader, files = g.edge_reader(c.PLACES), Files(spark)
        offsets = reader.offsets(1).withColumn(key, F.col("place")).withColumn(names.OFFSET, F.col(names.OFFSET) + F.when(F.col("place") == 10, 1).otherwise(0))
        offsets.repartition(1).sortWithinPartitions(key).select(names.OFFSET).write.parquet(f"{path}spare")
        files.move(files.glob(f"{path}spare/part-*")[0], f"{path}{reader.info.offset_path(Layout.BY_SOURCE, 1)}")
        files.write_count(f"{path}{reader.info.edge_count_path(Layout.BY_SOURCE, 1)}", reader.count(1) + 5)
        files.write_count(f"{path}{g.info.vertex('orders').count_path()}", orders.count() + 1)
        return Graph.load(spark, f"{path}faulty.graph.yml")

    edge = f"'customer_places_orders:{Layout.BY_SOURCE.value}'"
    before = lambda v: f"(SELECT count(*) FROM {place} WHERE src // {PART} = 1 AND src < {PART + v})"
    some = f"{before(11)} > {before(10)}"
    orders = "(SELECT count(*) FROM orders)"
    planted = [
        f"SELECT 'edge_end', {edge}, 0, (SELECT count(*) FROM {place} WHERE src <= 3) // {CHUNK}, 1, 0 WHERE true",
        f"SELECT 'edge_count', {edge}, 1, NULL, {before(PART)} + 5, {before(PART)} WHERE true",
        f"SELECT 'edges_begin', {edge}, 1, 10, {before(10)}, {before(10)} + 1 WHERE {some}",
        f"SELECT 'edges_end', {edge}, 1, 9, {before(10)}, {before(10)} + 1 WHERE true",
        f"SELECT 'edges_end', {edge}, 1, 10, {before(10)} + 1, {before(10)} WHERE NOT {some}",
        f"SELECT 'offset_falls', {edge}, 1, 10, {before(10)}, {before(10)} + 1 WHERE NOT {some}",
        f"SELECT 'vertex_rows', 'orders:o_orderkey/', {orders} // {PART}, NULL, {orders} % {PART}, {orders} % {PART} + 1 WHERE true",
        f"SELECT 'vertex_last', 'orders:o_orderkey/', {orders} // {PART}, NULL, {orders} - 1, {orders} WHERE {orders} % {PART} > 0",
    ]
    over("verify_faults", f"SELECT what, type, part::BIGINT AS part, chunk::BIGINT AS chunk, found::BIGINT AS found, expected::BIGINT AS expected FROM ({' UNION ALL '.join(planted)}) t(what, type, part, chunk, found, expected)", faulty)(verify.faults)
