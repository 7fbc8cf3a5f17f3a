"""Iterative analytics over edges (src, dst ids) and dense vertex ids. Loops run on the driver, data stays in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import names
from ..session import cut, cut_dealt

V, S, D = names.VERTEX, names.SRC, names.DST
#: Rounds of a loop between two cuts of the lineage.
CUT_EVERY = 3
#: Edges that a hub has at least.
HUB = 100_000
_HUB = "_hub"


def _ids(edges: DataFrame, vertices: int) -> DataFrame:
    return edges.sparkSession.range(vertices).withColumnRenamed("id", V)


class _Links:
    """Edges dealt by one end for joins with values of these ids in many rounds: a vertex cut.

    Edges of most ids are dealt by the id, and a checkpoint keeps the dealing, so that a round moves the values only. An
    id that has more edges than a task's share, and than HUB, is a hub: its edges are dealt evenly over all tasks, and
    its value is broadcast to them. There are at most as many hubs as tasks.
    """

    def __init__(self, edges: DataFrame, end: str):
        spark, self.end = edges.sparkSession, end
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = cut(edges)
        degrees = rows.groupBy(F.col(end).alias(_HUB)).agg(F.count("*").alias("_n"))
        share = max(HUB, (degrees.agg(F.sum("_n")).head()[0] or 0) // tasks)
        hubs = cut(degrees.filter(F.col("_n") > share).select(_HUB))
        self.hubs = None if hubs.isEmpty() else F.broadcast(hubs)
        is_hub = F.col(end) == F.col(_HUB)
        light = rows if self.hubs is None else rows.join(self.hubs, is_hub, "left_anti")
        self.light = cut_dealt(light.repartition(tasks, end))
        self.heavy = None if self.hubs is None else cut(rows.join(self.hubs, is_hub, "left_semi").repartition(tasks))

    def meet(self, values: DataFrame) -> DataFrame:
        """Edges with the values (a row for an id, in a column named as the end) of their ends; edges without any go.

        Values go to the edges of their task, not through the driver: a loop of many rounds would leave it one broadcast
        of them after the other.
        """
        found = self.light.join(values.hint("shuffle_hash"), self.end)
        if self.heavy is None:
            return found
        of_hubs = values.join(self.hubs, F.col(self.end) == F.col(_HUB), "left_semi")
        return found.unionByName(self.heavy.join(F.broadcast(of_hubs), self.end))

    def without(self, values: DataFrame, column: str) -> _Links:
        """The edges whose other column isn't among the values."""
        out = object.__new__(_Links)
        out.end, out.hubs = self.end, self.hubs
        out.light, out.heavy = (None if x is None else x.join(values, column, "left_anti") for x in (self.light, self.heavy))
        return out


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(S, D).union(edges.select(F.col(D).alias(S), F.col(S).alias(D)))


def pagerank(edges: DataFrame, vertices: int, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank). A vertex without outgoing edges keeps damping times its own rank; mass isn't spread.

    Parallel edges count each. Messages are summed before the join with the vertices.
    """
    counted = cut(edges.groupBy(S, D).agg(F.count("*").cast("double").alias("_w")))
    pairs = _Links(counted, S)
    out = counted.groupBy(F.col(S).alias(V)).agg(F.sum("_w").alias("_out"))
    ranks = cut(_ids(edges, vertices).join(out, V, "left").withColumn("rank", F.lit(1.0 / vertices if vertices else 0.0)))
    for k in range(rounds):
        share = ranks.filter("_out is not null").select(F.col(V).alias(S), (F.col("rank") / F.col("_out")).alias("_share"))
        got = pairs.meet(share).groupBy(F.col(D).alias(V)).agg(F.sum(F.col("_share") * F.col("_w")).alias("_got"))
        new = damping * (F.coalesce("_got", F.lit(0.0)) + F.when(F.col("_out").isNull(), F.col("rank")).otherwise(0.0)) + (1 - damping) / vertices
        ranks = ranks.join(got, V, "left").select(V, "_out", new.alias("rank"))
        if (k + 1) % CUT_EVERY == 0 and k + 1 < rounds:
            ranks = cut(ranks)
    return ranks.select(V, "rank")


def _search(edges: DataFrame, vertices: int, root: int, pull: bool = False) -> DataFrame:
    """(id, distance, father) of reached vertices; the father is the smallest id of the level before.

    Pushing goes from the frontier along edges and drops what was reached; pulling goes from edges of unreached ends.
    """
    spark = edges.sparkSession
    if not 0 <= root < vertices:
        return spark.createDataFrame([], f"{V} long, distance int, father long")
    links = _Links(edges.select(S, D).filter(F.col(S) != F.col(D)).distinct(), S)
    reached = spark.createDataFrame([(root, 0, root)], f"{V} long, distance int, father long")
    frontier, level = reached, 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        level += 1
        open_links = links.without(reached.select(F.col(V).alias(D)), D) if pull else links
        step = open_links.meet(frontier.select(F.col(V).alias(S))).groupBy(F.col(D).alias(V)).agg(F.min(S).alias("father"))
        frontier = cut(step.join(reached.hint("merge"), V, "left_anti").select(V, F.lit(level).alias("distance"), "father"))
        if frontier.isEmpty():
            return reached
        reached = reached.union(frontier)
        if level % CUT_EVERY == 0:
            reached = cut(reached.coalesce(tasks))  # each union adds the frontier's partitions


def bfs(edges: DataFrame, vertices: int, root: int = 0, pull: bool = False) -> DataFrame:
    """(id, distance) of all vertices along directed edges; -1 where none leads. `pull` searches from the unreached side, with the same result."""
    found = _search(edges, vertices, root, pull)
    return _ids(edges, vertices).join(found, V, "left").select(V, F.coalesce("distance", F.lit(-1)).alias("distance"))


def bfs_fathers(edges: DataFrame, vertices: int, root: int = 0) -> DataFrame:
    """(id, father): the root is its own, unreached vertices have -1."""
    found = _search(edges, vertices, root)
    return _ids(edges, vertices).join(found, V, "left").select(V, F.coalesce("father", F.lit(-1)).alias("father"))


def bfs_tree(edges: DataFrame, vertices: int, root: int = 0) -> DataFrame:
    """The search as edges from father to child."""
    return bfs_fathers(edges, vertices, root).filter((F.col("father") >= 0) & (F.col("father") != F.col(V))).select(F.col("father").alias(S), F.col(V).alias(D))


def weak_components(edges: DataFrame, vertices: int) -> DataFrame:
    """(id, component): the smallest id that edges lead to in either direction.

    A vertex takes the smallest label around it and then that label's own label, so long chains halve each round. Both
    sides of that second join are plain tables, so the label that most vertices have is split by adaptive execution.
    """
    links = _Links(both_ways(edges).filter(F.col(S) != F.col(D)).distinct(), D)
    labels = _ids(edges, vertices).withColumn("component", F.col(V))
    while True:
        near = links.meet(labels.withColumnRenamed(V, D)).groupBy(F.col(S).alias(V)).agg(F.min("component").alias("_near"))
        low = labels.join(near, V, "left").select(V, "component", F.least("component", "_near").alias("_low"))
        jump = labels.select(F.col(V).alias("_low"), F.col("component").alias("_jump"))
        new = cut(low.join(jump, "_low").select(V, F.least("_low", "_jump").alias("_new"), "component"))
        labels = new.select(V, F.col("_new").alias("component"))
        if new.filter("_new <> component").isEmpty():
            return labels


def numbered_components(edges: DataFrame, vertices: int) -> DataFrame:
    """(id, component) with components numbered from 0 in the order of their smallest vertex."""
    from .ranking import number_rows

    found = weak_components(edges, vertices)
    heads = number_rows(found.filter(F.col(V) == F.col("component")).select("component"), [F.col("component")], "number")
    return found.join(heads, "component").select(V, F.col("number").alias("component"))


def component_count(found: DataFrame) -> int:
    return found.select("component").distinct().count()


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("component").agg(F.count("*").alias("vertices"))


def two_hop(edges: DataFrame, root: int) -> DataFrame:
    """Distinct ids two edges away from a vertex (paths may lead back)."""
    first = edges.filter(F.col(S) == root).select(F.col(D).alias("_m")).distinct()
    return first.join(edges, F.col("_m") == F.col(S)).select(F.col(D).alias(V)).distinct()


def top_degrees(edges: DataFrame, k: int, end: str = S) -> DataFrame:
    """The k vertices of most edges, ties to the smaller id."""
    counted = edges.groupBy(F.col(end).alias(V)).agg(F.count("*").alias("degree"))
    return counted.orderBy(F.col("degree").desc(), V).limit(k)


def rank_within(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group in an order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= k)
