"""Exact top-k by integer inner product with MaxScore over shards.

A vector's dimensions are its query terms. What a term adds to a row is counted from the least that it adds to any row
of the shard, so all impacts are at least 0 and a term's bound is its largest impact. Terms stand in the order of their
bounds. A threshold, the k-th best score known, splits them: the last terms whose bounds together can't lift a row to
the threshold are non-essential. The postings of the essential ones are traversed, a block of rows at a time; what
these rows still lack is probed term by term, the largest bound first, and rows are dropped as soon as their partial
score and the bounds that are left fall below the threshold. Each block's survivors raise the threshold, which moves
the split for the blocks after it. What the shards find is merged per query.

Queries meet rows in blocks: each pair of a shard and a block of queries is a group of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SHARD_ROWS, BLOCK_QUERIES = 8_192, 4_096
#: Rows traversed at a time, rows scored in full for the first threshold, and terms probed at a time.
TRAVERSED, SEEDS, PROBED = 4_096, 64, 4


def max_score(query: np.ndarray, terms: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, traversed: int = TRAVERSED) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may be among the k best, all of these among them, and their exact scores.

    terms: dimensions x rows; low, high: each dimension's extremes.
    """
    least = np.minimum(query * low, query * high)
    bound = np.maximum(query * low, query * high) - least
    order = np.argsort(-bound, kind="stable")
    lows, bound = least[order], bound[order]
    left = np.concatenate([np.cumsum(bound[::-1])[::-1], [0.0]])  # what the terms from each on may still add
    base, total = least.sum(), terms.shape[1]
    if total <= k:
        return np.arange(total), query @ terms
    lead = query[order[:PROBED]] @ terms[order[:PROBED]]
    seeds = np.argpartition(-lead, min(max(SEEDS, k), total) - 1)[: max(SEEDS, k)]
    best = np.sort(query @ terms[:, seeds])[-k:]  # scores of k distinct rows: the threshold is the least of them
    out_rows, out_scores, unseen = [], [], np.ones(total, dtype=bool)
    unseen[seeds] = False
    for lo in range(0, total, traversed):
        threshold = best[0]
        # the essential terms end where those after them can't reach the threshold by themselves
        essential = int(np.searchsorted(-(base + left), -threshold, side="right"))
        rows = np.arange(lo, min(lo + traversed, total))
        own = order[:essential]
        partial = query[own] @ terms[:, lo : lo + traversed][own]
        at = essential
        while at < len(query):
            # impacts are counted from the least: what the terms from `at` on add is at most this
            alive = partial + left[at] + lows[at:].sum() >= threshold
            rows, partial = rows[alive], partial[alive]
            if not len(rows):
                break
            these = order[at : at + PROBED]
            partial = partial + query[these] @ terms[np.ix_(these, rows)]
            at += PROBED
        fine = partial >= threshold
        rows, partial = rows[fine], partial[fine]
        out_rows.append(rows), out_scores.append(partial)
        best = np.sort(np.concatenate([best, partial[unseen[rows]]]))[-k:]
    rows, scores = np.concatenate(out_rows), np.concatenate(out_scores)
    fine = scores >= best[0]
    return rows[fine], scores[fine]


def _pack(name: str, schema_ids: str):
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        matrix = np.ascontiguousarray(np.stack(pdf["_v"].to_numpy()).astype(np.float64))
        return pd.DataFrame({name: [int(keys[0])], "dim": [int(keys[1])], f"{name}_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], f"{name}_v": [matrix.tobytes()]})

    return run, f"{name} long, dim int, {name}_ids binary, {name}_v binary"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = 256, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows other than those of its own id; ties to the smaller id.

    Both tables have vec_id and `embedding`; components become floor(scale * x). Rows with a null id, a null or empty
    vector, or a null or non-finite component take no part; vectors of unlike lengths don't meet. Scores are exact
    while they stay below 2**53. Candidate rows that repeat an id are rows of their own; an id asks once, with the
    least of its vectors. An empty table of either kind gives an empty result.
    """

    def usable(df):
        x = F.col("embedding").cast("array<double>")
        fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter((F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("_v"))

    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("_v").alias("_v"))
    shards, blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, shard_rows), (asked, block_queries)))
    pairs = shards * blocks
    packed = []
    for df, name, n in ((rows, "shard", shards), (asked, "block", blocks)):
        run, schema = _pack(name, name)
        packed.append(df.withColumn("_dim", F.size("_v")).withColumn("_key", F.pmod(F.xxhash64("vec_id", "_v"), F.lit(n))).groupBy("_key", "_dim").applyInPandas(run, schema))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    key = ["shard", "block", "dim"]
    # a number of partitions of its own for the pairs: they are few and large
    left = packed[0].withColumn("block", every(blocks)).repartition(2 * pairs, *key)
    right = packed[1].withColumn("shard", every(shards)).repartition(2 * pairs, *key)

    def search(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        for r, q_row in ((r, b) for r in shard.itertuples(index=False) for b in block.itertuples(index=False)):
            ids, q_ids = np.frombuffer(r.shard_ids, np.int64), np.frombuffer(q_row.block_ids, np.int64)
            terms = np.ascontiguousarray(np.frombuffer(r.shard_v, np.float64).reshape(len(ids), -1).T)
            low, high = terms.min(axis=1), terms.max(axis=1)
            for q_id, q in zip(q_ids, np.frombuffer(q_row.block_v, np.float64).reshape(len(q_ids), -1), strict=True):
                own = int(np.searchsorted(ids, q_id, "right") - np.searchsorted(ids, q_id, "left"))
                at, s = max_score(q, terms, low, high, k + own)
                fine = ids[at] != q_id
                at, s = at[fine], s[fine]
                best = np.lexsort((ids[at], -s))[:k]
                out.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[at][best], "score": s[best].astype(np.int64)}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
