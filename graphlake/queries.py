"""Registered queries over the sample graph, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as c
from . import access_queries, names, stored_queries
from .functions import scalars
from .functions.expressions import Property as P
from .operators import algorithms as algo
from .operators import index, labels
from .operators import layout as lay
from .plans.graph import relayout, transform
from .plans.info import Layout, Property, PropertyGroup, VertexInfo
from .functions.types import GType
from .session import cut
from .sources.writer import VertexWriter
from .streaming import append as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
V, S, D = names.VERTEX, names.SRC, names.DST

CID = "(SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer)"
OID = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders)"
PID = "(SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part)"
PLACE = f"(SELECT a.id AS src, b.id AS dst, b.o_totalprice, b.o_orderdate FROM {OID} b JOIN {CID} a ON a.c_custkey = b.o_custkey)"
CONTAIN = f"(SELECT a.id AS src, b.id AS dst, l_linenumber, l_quantity, l_extendedprice FROM lineitem JOIN {OID} a ON a.o_orderkey = l_orderkey JOIN {PID} b ON b.p_partkey = l_partkey)"
FOLLOW_KEYS = "(SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderdate::DATE, o_orderpriority ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL AND dst <> src)"
FOLLOW = f"(SELECT a.id AS src, b.id AS dst FROM {FOLLOW_KEYS} f JOIN {CID} a ON a.c_custkey = f.src JOIN {CID} b ON b.c_custkey = f.dst)"
N_CUSTOMERS = "(SELECT count(*) FROM customer)"


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _ids(df: DataFrame) -> DataFrame:
    """Reserved columns under short names."""
    short = {V: "id", S: "src", D: "dst", names.PRIMARY: "key", names.EDGE: "edge", names.OFFSET: "offset"}
    return df.withColumnsRenamed({k: v for k, v in short.items() if k in df.columns})


# ---- index


@query("vertex_index_customer", f"SELECT id, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {CID}")
def vertex_index_customer(spark, d):
    return _ids(index.vertex_index(c.table(spark, d, "customer"), "c_custkey"))


@query("index_mapping_customer", f"SELECT c_custkey AS key, id FROM {CID}")
def index_mapping_customer(spark, d):
    return _ids(c.customer_map(spark, d))


@query("edge_src_index", f"SELECT a.id AS src, o_orderkey, o_totalprice, o_orderdate FROM orders JOIN {CID} a ON a.c_custkey = o_custkey")
def edge_src_index(spark, d):
    return _ids(index.source_index(c.places(spark, d), c.customer_map(spark, d), "o_custkey"))


@query("edge_dst_index", f"SELECT b.id AS dst, o_custkey, o_totalprice, o_orderdate FROM {OID} b")
def edge_dst_index(spark, d):
    return _ids(index.dest_index(c.places(spark, d), c.order_map(spark, d), "o_orderkey"))


@query("edge_src_dst_index", f"SELECT * FROM {PLACE}")
def edge_src_dst_index(spark, d):
    return _ids(c.place_ids(spark, d))


_UNITED = "(SELECT k, row_number() OVER (ORDER BY k) - 1 AS id FROM (SELECT src AS k FROM {e} UNION SELECT dst FROM {e}))"


@query("edge_united_index", f"SELECT a.id AS src, b.id AS dst FROM {FOLLOW_KEYS} f JOIN {_UNITED.format(e=FOLLOW_KEYS)} a ON a.k = f.src JOIN {_UNITED.format(e=FOLLOW_KEYS)} b ON b.k = f.dst")
def edge_united_index(spark, d):
    return _ids(index.united_index(c.follows(spark, d), "src", "dst"))


@query("edge_src_only_index", "SELECT k.id AS src, o_orderkey FROM orders JOIN (SELECT o_custkey AS k, row_number() OVER (ORDER BY o_custkey) - 1 AS id FROM (SELECT DISTINCT o_custkey FROM orders)) k ON k.k = o_custkey")
def edge_src_only_index(spark, d):
    return _ids(index.source_index_alone(c.places(spark, d).select("o_custkey", "o_orderkey"), "o_custkey"))


@query("edge_dst_only_index", "SELECT k.id AS dst, l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_partkey AS k, row_number() OVER (ORDER BY l_partkey) - 1 AS id FROM (SELECT DISTINCT l_partkey FROM lineitem)) k ON k.k = l_partkey")
def edge_dst_only_index(spark, d):
    return _ids(index.dest_index_alone(c.contains(spark, d).select("l_orderkey", "l_partkey", "l_linenumber"), "l_partkey"))


@query("edge_index_column", "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS edge, o_custkey, o_orderkey FROM orders")
def edge_index_column(spark, d):
    return _ids(index.edge_index(c.places(spark, d).select("o_custkey", "o_orderkey")))


@query("edges_to_primary_keys", "SELECT o_custkey AS src, o_orderkey AS dst, o_totalprice, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey")
def edges_to_primary_keys(spark, d):
    return index.to_primary_keys(c.place_ids(spark, d), c.customer_map(spark, d), c.order_map(spark, d))


@query("dangling_edges", "SELECT o_custkey, o_orderkey FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey WHERE s_suppkey IS NULL")
def dangling_edges(spark, d):
    suppliers = index.index_mapping(c.table(spark, d, "supplier"), "s_suppkey")
    return index.dangling_edges(c.places(spark, d).select("o_custkey", "o_orderkey"), suppliers, c.order_map(spark, d), "o_custkey", "o_orderkey")


# ---- layout: parts of 100 vertices, chunks of 128 edges

_ARRANGED = "(SELECT {main} // 100 AS part, row_number() OVER (PARTITION BY {main} // 100 ORDER BY {order}) - 1 AS position, src, dst, l_linenumber FROM " + CONTAIN + ")"
_CSR, _CSC = _ARRANGED.format(main="src", order="src, dst, l_linenumber"), _ARRANGED.format(main="dst", order="dst, src, l_linenumber")
_COO_SRC, _COO_DST = _ARRANGED.format(main="src", order="l_linenumber, dst, src"), _ARRANGED.format(main="dst", order="l_linenumber, src, dst")


def _arranged(spark, d, layout: Layout, ties: list[str]) -> DataFrame:
    edges = c.contain_ids(spark, d).select(S, D, "l_linenumber")
    return _ids(lay.arrange(edges, layout, 100, 128, ties).select(lay.PART, lay.POSITION, lay.CHUNK, S, D, "l_linenumber"))


for _name, _layout, _sql, _ties in (
    ("csr_layout", Layout.BY_SOURCE, _CSR, ["l_linenumber"]), ("csc_layout", Layout.BY_DEST, _CSC, ["l_linenumber"]),
    ("coo_by_src_parts", Layout.LOOSE_BY_SOURCE, _COO_SRC, ["l_linenumber", D, S]), ("coo_by_dst_parts", Layout.LOOSE_BY_DEST, _COO_DST, ["l_linenumber", S, D]),
):
    query(_name, f"SELECT part, position, position // 128 AS chunk, src, dst, l_linenumber FROM {_sql}")(lambda spark, d, x=_layout, t=_ties: _arranged(spark, d, x, t))

_OFFSETS = """
SELECT part, place, coalesce(sum(n) OVER (PARTITION BY part ORDER BY place), 0)::BIGINT AS "offset" FROM (
  SELECT p.part, q.place, CASE WHEN q.place = 0 THEN 0 ELSE coalesce(n, 0) END AS n
  FROM (SELECT unnest(range((count(*) + 99) // 100)) AS part FROM {vertices}) p CROSS JOIN (SELECT unnest(range(101)) AS place) q
  LEFT JOIN (SELECT {end} AS v, count(*) AS n FROM """ + CONTAIN + """ GROUP BY 1) e ON e.v = p.part * 100 + q.place - 1)
"""


@query("csr_offsets", _OFFSETS.format(vertices="orders", end="src"))
def csr_offsets(spark, d):
    return _ids(lay.offsets(c.contain_ids(spark, d), Layout.BY_SOURCE, 100, c.table(spark, d, "orders").count()))


@query("csc_offsets", _OFFSETS.format(vertices="part", end="dst"))
def csc_offsets(spark, d):
    return _ids(lay.offsets(c.contain_ids(spark, d), Layout.BY_DEST, 100, c.table(spark, d, "part").count()))


_PER_PART = f"SELECT p.part, coalesce(n, 0)::BIGINT AS edges FROM (SELECT unnest(range((count(*) + 99) // 100)) AS part FROM customer) p LEFT JOIN (SELECT src // 100 AS part, count(*) AS n FROM {PLACE} GROUP BY 1) e ON e.part = p.part"


def _per_part(spark, d) -> DataFrame:
    return lay.edges_per_part(c.place_ids(spark, d), Layout.BY_SOURCE, 100, c.table(spark, d, "customer").count())


@query("edges_per_vertex_chunk", _PER_PART)
def edges_per_vertex_chunk(spark, d):
    return _per_part(spark, d)


@query("vertex_chunk_sizes", f"SELECT id // 100 AS chunk, count(*) AS rows FROM {CID} GROUP BY 1")
def vertex_chunk_sizes(spark, d):
    return lay.vertex_chunk_sizes(index.vertex_index(c.table(spark, d, "customer"), "c_custkey"), 100)


@query("edge_chunk_numbers", f"SELECT part, (edges + 127) // 128 AS chunks FROM ({_PER_PART})")
def edge_chunk_numbers(spark, d):
    return lay.edge_chunk_numbers(_per_part(spark, d), 128)


@query("adjacency_range", f"""
SELECT id, sum(n) OVER (PARTITION BY id // 100 ORDER BY id)::BIGINT - n AS "begin", sum(n) OVER (PARTITION BY id // 100 ORDER BY id)::BIGINT AS "end"
FROM (SELECT v.id, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(((count(*) + 99) // 100) * 100)) AS id FROM customer) v LEFT JOIN (SELECT src, count(*) AS n FROM {PLACE} GROUP BY 1) e ON e.src = v.id)
""")
def adjacency_range(spark, d):
    offsets = lay.offsets(c.place_ids(spark, d), Layout.BY_SOURCE, 100, c.table(spark, d, "customer").count())
    return _ids(lay.adjacency_range(offsets, 100))


@query("global_chunk_index", f"""
SELECT (row_number() OVER (ORDER BY part, chunk) - 1)::BIGINT AS global_chunk, part, chunk
FROM (SELECT part, unnest(range((edges + 127) // 128)) AS chunk FROM ({_PER_PART}))
""")
def global_chunk_index(spark, d):
    return lay.global_chunks(_per_part(spark, d), 128)


# ---- stored graphs: each is written, read again, and its result kept


def _stored(read: Callable, **settings) -> Query:
    def run(spark, d):
        with c.workspace(spark) as path:
            return cut(read(c.store(spark, d, path, **settings)))

    return run


_VERTICES = f"SELECT id, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {CID}"
_EDGES = f"SELECT src, dst, o_totalprice, o_orderdate FROM {PLACE}"
_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
for _kind in ("parquet", "orc", "csv", "json"):
    query(f"rt_vertices_{_kind}", _VERTICES)(_stored(lambda g: _ids(g.vertex_reader("customer").all()), file_type=_kind, with_edges=False))
    query(f"rt_edges_{_kind}", f"SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge, * FROM ({_EDGES})")(_stored(lambda g: _ids(g.edge_reader(c.PLACES, Layout.BY_SOURCE).edges()), file_type=_kind))

query("rt_edges_by_dest", f"SELECT row_number() OVER (ORDER BY dst, src) - 1 AS edge, * FROM ({_EDGES})")(_stored(lambda g: _ids(g.edge_reader(c.PLACES, Layout.BY_DEST).edges())))
query("rt_edges_unordered", _EDGES)(_stored(lambda g: _ids(g.edge_reader(c.PLACES, Layout.LOOSE_BY_SOURCE).edges(add_index=False)), layouts=(Layout.LOOSE_BY_SOURCE, Layout.LOOSE_BY_DEST)))
query("rt_offsets", f"""
SELECT part, place, coalesce(sum(n) OVER (PARTITION BY part ORDER BY place), 0)::BIGINT AS "offset" FROM (
  SELECT p.part, q.place, CASE WHEN q.place = 0 THEN 0 ELSE coalesce(n, 0) END AS n
  FROM (SELECT unnest(range((count(*) + 499) // 500)) AS part FROM customer) p CROSS JOIN (SELECT unnest(range(501)) AS place) q
  LEFT JOIN (SELECT src AS v, count(*) AS n FROM {PLACE} GROUP BY 1) e ON e.v = p.part * 500 + q.place - 1)
""")(_stored(lambda g: _ids(g.edge_reader(c.PLACES, Layout.BY_SOURCE).all_offsets())))


@query("rt_multi_group", _VERTICES)
def rt_multi_group(spark, d):
    """Three column groups in three formats."""
    kinds = {"c_custkey": ("int64", "parquet"), "c_name": ("string", "orc"), "c_nationkey": ("int32", "orc"), "c_acctbal": ("double", "json"), "c_mktsegment": ("string", "json")}
    prop = lambda n: Property(n, GType.parse(kinds[n][0]), n == "c_custkey")
    groups = tuple(PropertyGroup(tuple(prop(n) for n in kinds if kinds[n][1] == t), t) for t in ("parquet", "orc", "json"))
    info = VertexInfo("customer", 400, groups, prefix="vertex/customer/")
    with c.workspace(spark) as path:
        VertexWriter(path, info, c.table(spark, d, "customer")).write()
        from .sources.reader import VertexReader

        return _ids(cut(VertexReader(spark, path, info).all()))


query("rt_labels", f"SELECT id, [c_mktsegment] AS labels FROM {CID}")(
    _stored(lambda g: _ids(g.vertex_reader("customer").labels().withColumnRenamed(names.LABELS, "labels")), with_edges=False)
)


@query("rt_list_property", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, len(embedding)::INTEGER AS n, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[-1]::DOUBLE, 5) AS last FROM embeddings")
def rt_list_property(spark, d):
    df = c.table(spark, d, "embeddings")
    group = PropertyGroup((Property("vec_id", GType.parse("int64"), True), Property("embedding", GType.parse("list<float>")), Property("label", GType.parse("int32"))))
    info = VertexInfo("vector", 200, (group,), prefix="vertex/vector/")
    with c.workspace(spark) as path:
        VertexWriter(path, info, df).write()
        from .sources.reader import VertexReader

        back = VertexReader(spark, path, info).all()
        ends = (F.round(F.element_at("embedding", at).cast("double"), 5).alias(x) for at, x in ((1, "first"), (-1, "last")))
        return _ids(cut(back.select(V, "vec_id", "label", F.size("embedding").alias("n"), *ends)))


@query("rt_date_timestamp", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, date_trunc('millisecond', o_orderdate)::TIMESTAMP AS at FROM orders")
def rt_date_timestamp(spark, d):
    df = c.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), scalars.to_millis_precision(F.col("o_orderdate").cast("timestamp")).alias("at"))
    group = PropertyGroup((Property("o_orderkey", GType.parse("int64"), True), Property("day", GType.parse("date")), Property("at", GType.parse("timestamp"))), "orc")
    info = VertexInfo("orders", 4000, (group,), prefix="vertex/orders/")
    with c.workspace(spark) as path:
        VertexWriter(path, info, df).write()
        from .sources.reader import VertexReader

        return _ids(cut(VertexReader(spark, path, info).all().withColumn("day", F.col("day").cast("string"))))


@query("count_files", f"SELECT 'customer' AS what, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'places', count(*) FROM {PLACE}")
def count_files(spark, d):
    """Counts from the count files, decoded in Spark."""
    with c.workspace(spark) as path:
        c.store(spark, d, path)
        raw = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", p).load(path)
        counted = raw("vertex_count").filter(F.col("path").contains("/vertex/")).select(F.regexp_extract("path", r"/vertex/(\w+)/", 1).alias("what"), scalars.little_endian_long(F.col("content")).alias("n"))
        edges = raw("edge_count*").filter(F.col("path").contains(Layout.BY_SOURCE.value)).agg(F.sum(scalars.little_endian_long(F.col("content"))).alias("n")).select(F.lit("places").alias("what"), "n")
        return cut(counted.unionByName(edges))


# ---- filters

_PREDICATES = {
    "eq": (P("c_nationkey") == 7, "c_nationkey = 7"), "ne": (P("c_mktsegment") != "BUILDING", "c_mktsegment <> 'BUILDING'"), "gt": (P("c_acctbal") > 5000.0, "c_acctbal > 5000"),
    "ge": (P("c_custkey") >= 100, "c_custkey >= 100"), "lt": (P("c_acctbal") < 0.0, "c_acctbal < 0"), "le": (P("c_nationkey") <= 3, "c_nationkey <= 3"),
    "not": (~(P("c_nationkey") == 7), "NOT c_nationkey = 7"), "and": ((P("c_acctbal") > 0.0) & (P("c_nationkey") < 10), "c_acctbal > 0 AND c_nationkey < 10"),
    "or": ((P("c_acctbal") < 0.0) | (P("c_mktsegment") == "MACHINERY"), "c_acctbal < 0 OR c_mktsegment = 'MACHINERY'"),
}
for _name, (_tree, _where) in _PREDICATES.items():  # over a stored table, whose scan takes the filter
    query(f"filter_{_name}", f"SELECT id, c_custkey FROM {CID} WHERE {_where}")(_stored(lambda g, t=_tree: _ids(g.vertices("customer").with_property(t).table(["c_custkey"])), with_edges=False))

query("project_filter", f"SELECT id, c_name FROM {CID} WHERE c_acctbal > 1000 AND c_nationkey <> 3")(
    _stored(lambda g: _ids(g.vertices("customer").with_property(P("c_acctbal") > 1000.0).with_property(P("c_nationkey") != 3).table(["c_name"])), with_edges=False)
)

#: Labels of documents: quality and toxic, as stated by the labels table; a document may have both or none.
_DOC = "(SELECT doc_id, coalesce(max(quality), 0) = 1 AS good, coalesce(max(toxic), 0) = 1 AS toxic, lang = 'en' AS english FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id, lang)"


def _flags(spark, d) -> DataFrame:
    known = c.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    docs = c.table(spark, d, "documents").select("doc_id", "lang").join(known, "doc_id", "left")
    return docs.select(F.col("doc_id").alias(V), (F.coalesce("q", F.lit(0)) == 1).alias("good"), (F.coalesce("t", F.lit(0)) == 1).alias("toxic"), (F.col("lang") == "en").alias("english"))


_KNOWN = ["good", "toxic", "english"]
query("label_single", f"SELECT doc_id AS id FROM {_DOC} WHERE good")(lambda spark, d: _ids(labels.with_all(_flags(spark, d), ["good"], _KNOWN).select(V)))
query("label_and", f"SELECT doc_id AS id FROM {_DOC} WHERE good AND english")(lambda spark, d: _ids(labels.with_all(_flags(spark, d), ["good", "english"], _KNOWN).select(V)))
query("label_or", f"SELECT doc_id AS id FROM {_DOC} WHERE toxic OR english")(lambda spark, d: _ids(labels.with_any(_flags(spark, d), ["toxic", "english"], _KNOWN).select(V)))
query("label_chain", f"SELECT doc_id AS id FROM {_DOC} WHERE good AND NOT toxic AND english")(
    lambda spark, d: _ids(labels.with_all(labels.with_all(_flags(spark, d), ["good"], _KNOWN).filter(~F.col("toxic")), ["english"], _KNOWN).select(V))
)
query("label_to_array", f"SELECT doc_id AS id, list_filter([CASE WHEN good THEN 'good' END, CASE WHEN toxic THEN 'toxic' END, CASE WHEN english THEN 'english' END], lambda x: x IS NOT NULL) AS labels FROM {_DOC}")(
    lambda spark, d: _ids(labels.to_list(_flags(spark, d), _KNOWN, "labels"))
)
query("array_to_label", f"SELECT doc_id AS id, good, toxic, english FROM {_DOC}")(lambda spark, d: _ids(labels.to_flags(labels.to_list(_flags(spark, d), _KNOWN, "labels"), _KNOWN, "labels")))
query("label_counts", f"SELECT 'good' AS label, count(*) FILTER (good) AS n FROM {_DOC} UNION ALL SELECT 'toxic', count(*) FILTER (toxic) FROM {_DOC} UNION ALL SELECT 'english', count(*) FILTER (english) FROM {_DOC}")(
    lambda spark, d: labels.counts(_flags(spark, d), _KNOWN)
)
query("label_stored_single", f"SELECT id FROM {CID} WHERE c_mktsegment = 'BUILDING'")(_stored(lambda g: _ids(g.vertices("customer").with_label("BUILDING").ids()), with_edges=False))
query("label_then_property", f"SELECT id, c_custkey FROM {CID} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")(
    _stored(lambda g: _ids(g.vertices("customer").with_label("BUILDING").with_property(P("c_acctbal") > 0.0).table(["c_custkey"])), with_edges=False)
)
query("label_none_in_common", f"SELECT id FROM {CID} WHERE c_mktsegment = 'BUILDING' AND c_mktsegment = 'MACHINERY'")(
    _stored(lambda g: _ids(g.vertices("customer").with_label("BUILDING").with_label("MACHINERY").ids()), with_edges=False)
)

# ---- access

query("out_neighbors", f"SELECT dst FROM {PLACE} WHERE src = 17")(_stored(lambda g: _ids(g.edges(c.PLACES, Layout.BY_SOURCE).out_edges(17, []).select(D))))
query("in_neighbors", f"SELECT src FROM {PLACE} WHERE dst = 17")(_stored(lambda g: _ids(g.edges(c.PLACES, Layout.BY_DEST).in_edges(17, []).select(S))))
query("in_neighbors_scan", f"SELECT src FROM {PLACE} WHERE dst = 18")(_stored(lambda g: _ids(g.edges(c.PLACES, Layout.BY_SOURCE).in_edges(18, []).select(S))))
query("edges_for_vertex_chunk", f"SELECT src, dst, o_totalprice, o_orderdate FROM {PLACE} WHERE src // 500 = 0")(_stored(lambda g: _ids(g.edge_reader(c.PLACES, Layout.BY_SOURCE).edges(0, add_index=False))))
query("edges_chunk_range", f"SELECT src, dst FROM {PLACE} WHERE dst // 500 BETWEEN 1 AND 2")(_stored(lambda g: _ids(g.edges(c.PLACES, Layout.BY_DEST).between(1, 3).table([]))))
query("two_hop", f"SELECT DISTINCT b.dst AS id FROM {FOLLOW} a JOIN {FOLLOW} b ON a.dst = b.src WHERE a.src = 0")(lambda spark, d: _ids(algo.two_hop(c.follow_ids(spark, d), 0)))
_DEGREE = f"SELECT v.id, coalesce(n, 0)::BIGINT AS degree FROM {CID} v LEFT JOIN (SELECT {{end}} AS id, count(*) AS n FROM {FOLLOW} GROUP BY 1) e ON e.id = v.id"
query("out_degree", _DEGREE.format(end="src"))(lambda spark, d: _ids(lay.all_degrees(c.follow_ids(spark, d), c.table(spark, d, "customer").count())))
query("in_degree", _DEGREE.format(end="dst"))(lambda spark, d: _ids(lay.all_degrees(c.follow_ids(spark, d), c.table(spark, d, "customer").count(), D)))

# ---- graph level

query("graph_read_counts", f"SELECT 'customer' AS what, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'ordered_by_source', count(*) FROM {PLACE} UNION ALL SELECT 'ordered_by_dest', count(*) FROM {PLACE}")(
    _stored(lambda g: _counts(g))
)


def _counts(g) -> DataFrame:
    vertices, edges = g.tables()
    tables = {**vertices, **{layout.value: df for layout, df in edges[c.PLACES].items()}}
    out = None
    for what, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _transformed(read: Callable, first: dict | None = None, **target) -> Query:
    def run(spark, d):
        with c.workspace(spark) as path, c.workspace(spark) as other:
            g = c.store(spark, d, path, **(first or {}))
            return cut(read(transform(g, relayout(g.info, other, **target))))

    return run


query("graph_transform_csr_to_csc", f"SELECT row_number() OVER (ORDER BY dst, src) - 1 AS edge, * FROM ({_EDGES})")(
    _transformed(lambda g: _ids(g.edge_reader(c.PLACES, Layout.BY_DEST).edges()), {"layouts": (Layout.BY_SOURCE,)}, layouts=(Layout.BY_DEST,))
)
query("graph_transform_filetype", _EDGES)(_transformed(lambda g: _ids(g.edge_reader(c.PLACES).edges(add_index=False)), {"layouts": (Layout.BY_SOURCE,)}, file_type="orc"))
query("graph_transform_rechunk", f"SELECT id // 300 AS chunk, count(*) AS rows FROM {CID} GROUP BY 1")(
    _transformed(lambda g: lay.vertex_chunk_sizes(g.vertex_reader("customer").group(g.info.vertex("customer").groups[0], []), 300), {"with_edges": False}, vertex_chunk=300)
)


@query("add_property_group", f"SELECT id, c_custkey, coalesce(n, 0)::BIGINT AS n_orders FROM {CID} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def add_property_group(spark, d):
    """The number of orders of each customer, written back as a new column group."""
    with c.workspace(spark) as path:
        g = c.store(spark, d, path, layouts=(Layout.BY_SOURCE,))
        n = lay.all_degrees(g.edge_reader(c.PLACES).edges(add_index=False, columns=[]), g.vertices("customer").count()).withColumnRenamed("degree", "n_orders")
        g = g.add_vertex_group("customer", PropertyGroup((Property("n_orders", GType.parse("int64")),), "orc"), cut(n))
        return _ids(cut(g.vertices("customer").table(["c_custkey", "n_orders"])))


@query("import_config", f"SELECT 'edge' AS what, src, dst FROM {PLACE}")
def import_config(spark, d):
    """Two vertex types and an edge type imported by a configuration, edges read back."""
    from .sources.importer import import_graph

    source = lambda name, columns: [{"path": f"{d}/{name}.parquet", "file_type": "parquet", "columns": {x: x for x in columns}}]
    prop = lambda n, t, primary=False: {"name": n, "data_type": t, "is_primary": primary}
    with c.workspace(spark) as path:
        g = import_graph(spark, {
            "graph": {"path": path, "name": "shop", "vertex_chunk_size": 500, "edge_chunk_size": 2000},
            "import_schema": {
                "vertices": [
                    {"type": "customer", "property_groups": [{"properties": [prop("c_custkey", "int64", True)]}, {"properties": [prop("c_name", "string")], "file_type": "csv"}], "sources": source("customer", ["c_custkey", "c_name"])},
                    {"type": "orders", "property_groups": [{"properties": [prop("o_orderkey", "int64", True), prop("o_totalprice", "double")]}], "sources": source("orders", ["o_orderkey", "o_totalprice"])},
                ],
                "edges": [{"src_type": "customer", "edge_type": "places", "dst_type": "orders", "src_prop": "c_custkey", "dst_prop": "o_orderkey", "sources": [{"path": f"{d}/orders.parquet", "file_type": "parquet", "columns": {"o_custkey": "c_custkey", "o_orderkey": "o_orderkey"}}]}],
            },
        })
        return _ids(cut(g.edge_reader(c.PLACES).edges(add_index=False).select(F.lit("edge").alias("what"), S, D)))


@query("edge_list_text", f"SELECT a.id AS src, b.id AS dst FROM {FOLLOW_KEYS} f JOIN {_UNITED.format(e=FOLLOW_KEYS)} a ON a.k = f.src JOIN {_UNITED.format(e=FOLLOW_KEYS)} b ON b.k = f.dst")
def edge_list_text(spark, d):
    """Edges written as text pairs, imported as a graph, and read back."""
    from .sources.importer import import_edge_list

    with c.workspace(spark) as path:
        c.follows(spark, d).select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(f"{path}pairs")
        g = import_edge_list(spark, f"{path}pairs", f"{path}graph/", vertex_chunk=512, edge_chunk=4096)
        return _ids(cut(g.edge_reader(("node", "links", "node"), Layout.BY_SOURCE).edges(add_index=False)))


# ---- analytics

_RANK = "r{k} AS (SELECT v.id, 0.85::DOUBLE * (coalesce(g.got, 0) + CASE WHEN o.n IS NULL THEN v.rank ELSE 0 END) + 0.15::DOUBLE / " + N_CUSTOMERS + " AS rank FROM r{j} v LEFT JOIN o ON o.id = v.id LEFT JOIN (SELECT e.dst AS id, sum(r.rank / o.n) AS got FROM e JOIN r{j} r ON r.id = e.src JOIN o ON o.id = e.src GROUP BY 1) g ON g.id = v.id)"
_PAGERANK = f"WITH e AS MATERIALIZED (SELECT * FROM {FOLLOW}), o AS MATERIALIZED (SELECT src AS id, count(*)::DOUBLE AS n FROM e GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / {N_CUSTOMERS} AS rank FROM {CID}), " + ", ".join(_RANK.format(k=k, j=k - 1).replace(f"r{k} AS (", f"r{k} AS MATERIALIZED (", 1) for k in range(1, 11))


def _customers(spark, d) -> int:
    return c.table(spark, d, "customer").count()


query("pagerank_10", _PAGERANK + " SELECT id, round(rank * 1000000, 3) AS rank FROM r10")(lambda spark, d: _ids(algo.pagerank(c.follow_ids(spark, d), _customers(spark, d))).select("id", F.round(F.col("rank") * 1_000_000, 3).alias("rank")))

_LEVELS = f"WITH RECURSIVE e AS (SELECT * FROM {FOLLOW}), b(id, distance) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, b.distance + 1 FROM b JOIN e ON e.src = b.id WHERE b.distance < 40), s AS (SELECT id, min(distance) AS distance FROM b GROUP BY 1)"
_BFS = _LEVELS + f" SELECT v.id, coalesce(s.distance, -1)::INTEGER AS distance FROM {CID} v LEFT JOIN s ON s.id = v.id"
query("bfs_distance", _BFS)(lambda spark, d: _ids(algo.bfs(c.follow_ids(spark, d), _customers(spark, d))))
query("bfs_pull", _BFS)(lambda spark, d: _ids(algo.bfs(c.follow_ids(spark, d), _customers(spark, d), pull=True)))
_FATHER = _LEVELS + f", f AS (SELECT e.dst AS id, min(e.src) AS father FROM e JOIN s a ON a.id = e.src JOIN s z ON z.id = e.dst WHERE z.distance = a.distance + 1 GROUP BY 1) SELECT v.id, CASE WHEN v.id = 0 THEN 0 ELSE coalesce(f.father, -1) END::BIGINT AS father FROM {CID} v LEFT JOIN f ON f.id = v.id"
query("bfs_father", _FATHER)(lambda spark, d: _ids(algo.bfs_fathers(c.follow_ids(spark, d), _customers(spark, d))))
query("bfs_tree_edges", f"SELECT father AS src, id AS dst FROM ({_FATHER}) WHERE father >= 0 AND father <> id")(lambda spark, d: _ids(algo.bfs_tree(c.follow_ids(spark, d), _customers(spark, d))))
_WCC = f"WITH RECURSIVE e AS (SELECT src, dst FROM {FOLLOW} UNION SELECT dst, src FROM {FOLLOW}), r(a, b) AS (SELECT id, id FROM {CID} UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), w AS (SELECT a AS id, min(b) AS component FROM r GROUP BY 1)"
query("wcc", _WCC + " SELECT id, component FROM w")(lambda spark, d: _ids(algo.weak_components(c.follow_ids(spark, d), _customers(spark, d))))
query("wcc_count", _WCC + " SELECT count(DISTINCT component) AS components FROM w")(lambda spark, d: algo.weak_components(c.follow_ids(spark, d), _customers(spark, d)).agg(F.count_distinct("component").alias("components")))
query("wcc_numbered", _WCC + " SELECT id, (dense_rank() OVER (ORDER BY component) - 1)::BIGINT AS component FROM w")(lambda spark, d: _ids(algo.numbered_components(c.follow_ids(spark, d), _customers(spark, d))))
query("wcc_sizes", _WCC + " SELECT component, count(*) AS vertices FROM w GROUP BY 1")(lambda spark, d: algo.component_sizes(algo.weak_components(c.follow_ids(spark, d), _customers(spark, d))))

# ---- interactive shapes over the graph

query("neighbors_sorted", f"SELECT p.dst, o_orderdate, o_totalprice FROM {PLACE} p WHERE src = 5")(
    lambda spark, d: _ids(c.place_ids(spark, d).filter(F.col(S) == 5).select(D, "o_orderdate", "o_totalprice").orderBy(F.col("o_orderdate").desc(), D))
)
query("recent_of_neighbors", f"SELECT src, dst, o_orderdate, place::INTEGER AS place FROM (SELECT p.src, p.dst, p.o_orderdate, row_number() OVER (PARTITION BY p.src ORDER BY p.o_orderdate DESC, p.dst) AS place FROM {PLACE} p JOIN (SELECT dst FROM {FOLLOW} WHERE src = 0) f ON f.dst = p.src) WHERE place <= 5")(
    lambda spark, d: _ids(algo.rank_within(c.place_ids(spark, d).join(c.follow_ids(spark, d).filter(F.col(S) == 0).select(F.col(D).alias(S)), S), S, [F.col("o_orderdate").desc(), F.col(D)], 5).select(S, D, "o_orderdate", "place"))
)
query("label_month_counts", f"SELECT c_mktsegment AS label, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS n, round(sum(p.o_totalprice), 2) AS total FROM {PLACE} p JOIN {CID} v ON v.id = p.src GROUP BY 1, 2, 3")(
    lambda spark, d: c.place_ids(spark, d)
    .join(index.vertex_index(c.table(spark, d, "customer"), "c_custkey").select(F.col(V).alias(S), "c_mktsegment"), S)
    .groupBy(F.col("c_mktsegment").alias("label"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
)
query("top_degrees", f"SELECT src AS id, count(*) AS degree FROM {FOLLOW} GROUP BY 1 ORDER BY degree DESC, id LIMIT 10")(lambda spark, d: _ids(algo.top_degrees(c.follow_ids(spark, d), 10)))

# ---- streaming


@query("stream_append_events", "SELECT id, event_id, user_id, event_type FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, * FROM events)")
def stream_append_events(spark, d):
    """The events read as a stream and appended to a stored vertex table."""
    props = tuple(Property(n, GType.parse(t), n == "event_id") for n, t in (("event_id", "int64"), ("user_id", "int64"), ("event_type", "string")))
    info = VertexInfo("event", 3000, (PropertyGroup(props),), prefix="vertex/event/")
    with c.workspace(spark) as path:
        schema = c.table(spark, d, "events").schema
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").format("parquet").load(f"{d}/events.parquet*").select("event_id", "user_id", "event_type")
        running = streaming.stream_into(stream, path, info, "event_id", f"{path}progress")
        running.awaitTermination()
        from .sources.reader import VertexReader

        return _ids(cut(VertexReader(spark, path, info).all()))


query("windowed_event_counts", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, (date_trunc('hour', ts) + INTERVAL 1 HOUR)::TIMESTAMP AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda spark, d: streaming.windowed_counts(c.table(spark, d, "events"), "ts", "event_type")
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers with one label, counted: written, read again with its label filter, and joined."""
    with c.workspace(spark) as path:
        g = c.store(spark, sf_dir, path, vertex_chunk=100, edge_chunk=1024, layouts=(Layout.BY_SOURCE,))
        chosen = g.vertices("customer").with_label("BUILDING").table(["c_custkey"])
        degree = lay.degrees(g.edge_reader(c.PLACES).edges(add_index=False, columns=[]))
        return _ids(cut(chosen.join(degree, V, "left").select(V, "c_custkey", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.col("degree").desc(), V)))


query("flagship", f"SELECT v.id, c_custkey, count(p.dst) AS degree FROM {CID} v LEFT JOIN {PLACE} p ON p.src = v.id WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2")(flagship)

access_queries.register(query, {"CID": CID, "PLACE": PLACE, "FOLLOW": FOLLOW, "LEVELS": _LEVELS}, _ids)
stored_queries.register(query, {"CID": CID, "PLACE": PLACE, "BFS": _BFS, "WCC": _WCC, "FATHER": _FATHER}, _ids)
