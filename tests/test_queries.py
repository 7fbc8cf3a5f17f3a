"""Every kind of registered query against its SQL on the smallest tables, where they are."""

import os

import pytest

import __spark_entry__ as entry
from graphlake import queries as graph_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [
    "vertex_index_customer", "edge_src_dst_index", "edge_united_index", "dangling_edges", "csr_layout", "coo_by_dst_parts", "csr_offsets", "adjacency_range", "global_chunk_index",
    "filter_and", "label_and", "label_to_array", "out_degree", "pagerank_10", "bfs_father", "wcc", "count_files", "rt_edges_orc", "import_config", "stream_append_events",
    "edge_group_chunk", "edge_groups_all", "edge_chunk_counts", "cursor_vertices", "cursor_labels", "cursor_adjacency", "cursor_offsets", "cursor_walk", "vertex_find", "vertex_labels_of",
    "edge_iterate", "graph_read_labels", "edges_loose_by_dest", "rt_clashing_names_parquet", "rt_clashing_names_json", "null_property", "table_differences", "builder_append", "install_chunks",
    "import_formats", "import_delimited_files", "bfs_tree_stored",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(values):
    def plain(v):
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, duck, name):
    got = graph_queries.QUERIES[name](spark, DATA)
    want = duck.sql(graph_queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(graph_queries.ORACLE_SQL) == set(graph_queries.QUERIES)


def test_numbers_are_dense_in_any_partitioning(spark):
    from pyspark.sql import functions as F

    from graphlake.operators.ranking import number_rows, number_within

    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k"), (F.col("id") % 5).alias("g")).repartition(9)
    ranked = [r["n"] for r in number_rows(df, [F.col("k")], "n", 6).orderBy("k").collect()]
    assert ranked == list(range(10_000))
    within = number_within(df, [F.col("g")], [F.col("k")], "n").groupBy("g").agg(F.max("n").alias("m"), F.count_distinct("n").alias("c")).collect()
    assert all(r["m"] == 1_999 and r["c"] == 2_000 for r in within)


def test_filters_reach_the_scan(spark, tmp_path):
    from graphlake import catalog
    from graphlake.functions.expressions import Property as P

    g = catalog.store(spark, DATA, f"{tmp_path}/", with_edges=False)
    plan = g.vertices("customer").with_property(P("c_acctbal") > 5000.0).table(["c_custkey"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,5000.0)" in plan and "c_name" not in plan
    plan = g.vertices("customer").with_label("BUILDING").ids()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(BUILDING,true)" in plan or "IsNotNull(BUILDING)" in plan
