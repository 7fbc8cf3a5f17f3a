"""The sample property graph over the test tables, and stored copies of it."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import names
from .errors import InvalidError
from .operators import index
from .plans.graph import Graph, GraphWriter
from .plans.info import Layout
from .session import shared_folder
from .sources.fs import Files

PLACES, CONTAINS, FOLLOWS = ("customer", "places", "orders"), ("orders", "contains", "part"), ("customer", "follows", "customer")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to order."""
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to part."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to the customer of the next order of the same day and priority."""
    nxt = F.lead("o_custkey").over(Window.partitionBy(F.to_date("o_orderdate"), "o_orderpriority").orderBy("o_orderkey"))
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), nxt.alias("dst"))
    return pairs.filter("dst is not null and dst <> src").distinct()


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their market segment as a label."""
    df = table(spark, sf_dir, "customer")
    return df.withColumn(names.LABELS, F.array("c_mktsegment"))


def customer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_mapping(table(spark, sf_dir, "customer"), "c_custkey")


def order_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_mapping(table(spark, sf_dir, "orders"), "o_orderkey")


def part_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_mapping(table(spark, sf_dir, "part"), "p_partkey")


def place_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.both_indexes(places(spark, sf_dir), customer_map(spark, sf_dir), order_map(spark, sf_dir))


def contain_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.both_indexes(contains(spark, sf_dir), order_map(spark, sf_dir), part_map(spark, sf_dir))


def follow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = customer_map(spark, sf_dir)
    return index.both_indexes(follows(spark, sf_dir), mapping, mapping)


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder for a stored graph in the session's shared checkpoint folder, removed at the end."""
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}/"
    try:
        yield path
    finally:
        Files(spark).delete(path)


@contextlib.contextmanager
def database(spark: SparkSession, path: str) -> Iterator[str]:
    """The JDBC address in `spark.graphlake.jdbc.url`; where it is unset, of a database below `path`, in local sessions only.

    The latter is the one whose driver Spark brings; it runs within the driver's process, which executors can't reach.
    """
    known = spark.conf.get("spark.graphlake.jdbc.url", None)
    if known:
        yield known
        return
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise InvalidError("set spark.graphlake.jdbc.url to a database that all executors reach")
    place = path.removeprefix("file:").rstrip("/")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    try:
        yield f"jdbc:derby:{place}/db;create=true"
    finally:
        with contextlib.suppress(Py4JJavaError):  # it says by an error that it has stopped
            spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{place}/db;shutdown=true")


def store(spark: SparkSession, sf_dir: str, path: str, file_type: str = "parquet", layouts: tuple[Layout, ...] = (Layout.BY_SOURCE, Layout.BY_DEST), vertex_chunk: int = 500, edge_chunk: int = 2_000, with_edges: bool = True) -> Graph:
    """Customers (labelled), orders and the edges between them, written below a path."""
    labels = SEGMENTS if file_type != "csv" else SEGMENTS
    writer = GraphWriter(spark).put_vertices("customer", customers(spark, sf_dir), "c_custkey", labels).put_vertices("orders", table(spark, sf_dir, "orders"), "o_orderkey")
    if with_edges:
        writer.put_edges(PLACES, places(spark, sf_dir), "o_custkey", "o_orderkey")
    return writer.write(writer.infer("sample", path, vertex_chunk, edge_chunk, file_type, layouts))
