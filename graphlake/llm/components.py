"""Connected components of a table of links, by contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that are contracted at once, on the driver (16 bytes each), and not in rounds.
FEW = 1 << 17


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def contracted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the nodes 0..n - 1 that each is linked to by links (a, b)."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _of_few(links: DataFrame) -> DataFrame:
    """(node, component) of links that the driver can hold."""
    found = links.toArrow()
    nodes, ends = np.unique(np.concatenate([found[c].to_numpy() for c in "ab"]).astype(np.int64), return_inverse=True)
    root = contracted(len(nodes), *ends.reshape(2, -1))
    return links.sparkSession.createDataFrame(pa.table({"node": nodes, "component": nodes[root]}), "node long, component long")


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component: the smallest node reachable) of the nodes of `links` (a, b: long); an empty table gives none.

    Each round a node takes the smallest of itself and its neighbours in an order that is dealt anew by a hash, and nodes
    that took the same become one, so that paths of any length shrink by a share each round: rounds grow with the
    logarithm of the nodes, and end when at most `few` links are left, which the driver contracts. Only nodes with links
    take part. Rounds are written tables, not checkpoints: these keep what is known of their columns, to which each join
    adds as much again.
    """
    with common.scratch(links.sparkSession) as path:
        both = common.written(links.select("a", "b").filter("a <> b"), f"{path}/given")
        if both.count() <= few:
            return common.cut(_of_few(both))
        both = common.written(_both_ways(both), f"{path}/links")
        steps: list[DataFrame] = []
        while both.count() > 2 * few:
            k = len(steps)
            order = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
            low = both.groupBy("a").agg(F.least(order("a"), F.min(order("b")))["v"].alias("to"))
            steps.append(common.written(low.select(F.col("a").alias("node"), "to"), f"{path}/step{k}"))
            of = lambda c: steps[-1].select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))  # noqa: B023, E731
            both = both.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct()
            both = common.written(both, f"{path}/links{k}")
        steps.append(common.written(_of_few(both.filter("a < b")).withColumnRenamed("component", "to"), f"{path}/few"))
        # what a node became, from the last round back to the first
        last = steps[-1].withColumnRenamed("to", "head")
        for k, step in reversed(list(enumerate(steps[:-1]))):
            step = step.join(last.select(F.col("node").alias("to"), F.col("head")), "to", "left").select("node", F.coalesce("head", "to").alias("head"))
            last = common.written(step, f"{path}/heads{k}")
        smallest = last.groupBy("head").agg(F.min("node").alias("component"))
        return common.cut(last.join(smallest, "head").select("node", "component"))


def extended(found: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """`found` (node, component) with the components that further links (a, b) join, and their new nodes; written to `path`."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    across = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    joined = components(across)
    new = joined.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    to = joined.select(F.col("node").alias("_from"), F.col("component").alias("_to"))
    return common.written(found.unionByName(new).join(to, F.col("component") == F.col("_from"), "left").select("node", F.coalesce("_to", "component").alias("component")), path)
