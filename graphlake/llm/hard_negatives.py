"""Hard negatives by a distributed kNN join over a Voronoi partition, with exact scores.

Rows become whole numbers. Inner products become distances by one more coordinate: a row s gets sqrt(M - |s|^2), where
M is the largest squared norm, an anchor a gets 0, and then |a - s|^2 = |a|^2 + M - 2 a.s, so the best scores are the
nearest rows. A bounded sample of rows gives the pivots; each row belongs to the cell of its nearest pivot and keeps its
distance d to it. Anchors are dealt to groups by coarser cells.

What an anchor still needs is a ball around it (positives: the k-th best score that it has with rows of the sample; for
negatives the third best one in a positive's range) or, for negatives, a shell, as scores have an upper end too. For a
pivot p the triangle inequality turns this into bounds of d: |a - p| - d is the least distance that a row of p's cell
may have to a, |a - p| + d the largest. The least d that any anchor of a group needs in a cell is that group's bound
there. A join on the cell replicates a row to those groups only whose bound it meets; what no bound lets through can't
be among the results. Rows then meet a group's anchors in blocks, and the blocks' best are merged by anchor.

Bounds are of groups and cells, so their table is small beside the rows; blocks of a group are dealt by a hash, so a
cell with a third of all rows is many tasks' work, and so is a group that needs all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .vectors import exact_product, whole_rows

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
RANGE = (50, 95)
#: Sampled rows, with which first bounds are made; so many of them are pivots at most, and a pivot has that many rows on average.
SAMPLE, PIVOTS, ROWS_A_PIVOT = 4_096, 256, 512
#: Anchors of a group and rows of a block on average; a large cell of anchors is dealt to several groups.
GROUP, BLOCK = 2_048, 8_192
#: Anchors scored at once.
SLICE = 256

_NONE = np.iinfo(np.int64).min


def _distances(x: np.ndarray, sizes: np.ndarray, pivots: np.ndarray, top: int, is_anchor: bool) -> np.ndarray:
    """Distances of rows, or anchors, to pivots in the space with the added coordinate; `sizes` are squared norms."""
    norms = (pivots * pivots).sum(axis=1)
    squares = (sizes[:, None] + norms[None, :] - 2 * exact_product(x, pivots)).astype(np.float64)
    high = np.sqrt((top - norms).astype(np.float64))
    own = np.zeros(len(x)) if is_anchor else np.sqrt((top - sizes).astype(np.float64))
    return np.sqrt(np.maximum(squares + (own[:, None] - high[None, :]) ** 2, 0.0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _ends(positive: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score in the range of each positive score, in whole numbers."""
    return -((-span[0] * positive) // 100), (span[1] * positive) // 100


class _Rows:
    """A packed block of rows."""

    def __init__(self, ids, labels, v):
        self.ids, self.labels = np.asarray(ids, np.int64), np.asarray(labels, np.int64)
        self.v = np.stack(v).astype(np.int64) if len(v) else np.zeros((0, 0), np.int64)
        self.sizes = (self.v * self.v).sum(axis=1)

    def part(self, at) -> _Rows:
        out = object.__new__(_Rows)
        out.ids, out.labels, out.v, out.sizes = self.ids[at], self.labels[at], self.v[at], self.sizes[at]
        return out


class _Space:
    """What tasks need of the space: the sample, whose first rows are the pivots, and M."""

    def __init__(self, sample: _Rows, pivots: int, top: int):
        self.sample, self.pivots, self.top = sample, sample.v[:pivots], top


def positives_of(anchors: _Rows, rows: _Rows, k: int):
    """(anchor's place, row's place, score) of each anchor's k best other rows of its label, all of them among `rows`."""
    out = []
    for label in np.unique(anchors.labels):
        mine, theirs = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
        for lo in range(0, len(mine) if len(theirs) else 0, SLICE):
            scores = exact_product(anchors.v[mine[lo : lo + SLICE]], rows.v[theirs])
            for a, s in zip(mine[lo : lo + SLICE], scores, strict=True):
                other = np.flatnonzero(rows.ids[theirs] != anchors.ids[a])
                at = other[_best(s[other], rows.ids[theirs[other]], k)]
                out.extend((int(a), int(theirs[i]), int(s[i])) for i in at)
    return out


def negatives_of(anchors: _Rows, positive: list[np.ndarray], rows: _Rows, k: int, span: tuple[int, int]):
    """(anchor's place, place of its positive score, row's place, score): the k best in range among rows of other labels."""
    out = []
    for lo in range(0, len(anchors.ids) if len(rows.ids) else 0, SLICE):
        scores = exact_product(anchors.v[lo : lo + SLICE], rows.v)
        for a, s in enumerate(scores, lo):
            least, most = _ends(positive[a], span)
            if not len(least) or not (most >= least).any():
                continue
            fine = np.flatnonzero((s >= least.min()) & (s <= most.max()) & (rows.labels != anchors.labels[a]))
            fine = fine[np.lexsort((rows.ids[fine], -s[fine]))]
            down = -s[fine]  # ascending
            begin, end = np.searchsorted(down, -most, "left"), np.searchsorted(down, -least, "right")
            for p, (b, e) in enumerate(zip(begin, np.minimum(end, begin + k), strict=True)):
                out.extend((a, p, int(i), int(s[i])) for i in fine[b:e])
    return out


def _radius(anchors: _Rows, score: np.ndarray, top: int) -> np.ndarray:
    """How far a row may be from an anchor to have that score."""
    return np.sqrt(np.maximum((anchors.sizes + top).astype(np.float64) - 2.0 * score.astype(np.float64), 0.0))


def _needs(space: _Space, anchors: _Rows, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Per cell the least distance to its pivot of a row that may be within [near, far] of any anchor."""
    from_pivots = _distances(anchors.v, anchors.sizes, space.pivots, space.top, True)
    slack = 1e-6 * (1.0 + np.sqrt(float(space.top)))  # for rounding
    ball, shell = (from_pivots - far[:, None]).min(axis=0), (near[:, None] - from_pivots).min(axis=0)
    return np.maximum(ball, shell) - slack


def _first_bounds(space: _Space, anchors: _Rows, k: int):
    """label, needs per cell: for the positives of a group's anchors of each label."""
    score = np.full(len(anchors.ids), _NONE, np.int64)
    found: dict[int, list[int]] = {}
    for a, _, s in positives_of(anchors, space.sample, k):
        found.setdefault(a, []).append(s)
    for a, known in found.items():
        if len(known) == k:
            score[a] = min(known)
    far = np.where(score == _NONE, np.inf, _radius(anchors, np.maximum(score, -(1 << 60)), space.top))
    for label in np.unique(anchors.labels):
        mine = np.flatnonzero(anchors.labels == label)
        yield int(label), _needs(space, anchors.part(mine), np.zeros(len(mine)), far[mine])


def _second_bounds(space: _Space, anchors: _Rows, positive: list[np.ndarray], k: int, span: tuple[int, int]):
    """The anchors that have any range, and needs per cell for their negatives."""
    found: dict[tuple[int, int], list[int]] = {}
    for a, p, _, s in negatives_of(anchors, positive, space.sample, k, span):
        found.setdefault((a, p), []).append(s)
    mine, low, high = [], [], []
    for a, own in enumerate(positive):
        least, most = _ends(own, span)
        known = np.array([min(found[a, p]) if len(found.get((a, p), ())) == k else _NONE for p in range(len(own))], np.int64)
        some = most >= least
        if some.any():
            mine.append(a), low.append(np.maximum(least, known)[some].min()), high.append(most[some].max())
    if mine:
        part = anchors.part(np.array(mine))
        yield _needs(space, part, _radius(part, np.array(high), space.top), _radius(part, np.array(low), space.top))


ROW = "vec_id long, label long, v array<int>, place int"


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v, the row's place in its task, its squared norm and length, of the rows that take part."""

    def run(batches):
        place = 0
        for batch in batches:
            for at, x in whole_rows(batch.column("_v"), scale):
                own = batch.take(pa.array(at))
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.astype(np.int32).ravel()))
                numbers = [np.arange(place, place + len(x), dtype=np.int32), (x * x).sum(axis=1), np.full(len(x), x.shape[1], np.int32)]
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), v, *map(pa.array, numbers)], names=["vec_id", "label", "v", "place", "size", "dim"])
                place += len(x)

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").alias("_v")).filter("vec_id IS NOT NULL AND label IS NOT NULL")
    return rows.mapInArrow(run, f"{ROW}, size long, dim int")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _assigned(rows: DataFrame, space, pivots: int, name: str, is_anchor: bool) -> DataFrame:
    """Adds the cell of the nearest of the first `pivots` sampled rows, as `name`, and the distance to it, `d`."""

    def run(batches):
        own = space.value
        for batch in batches:
            if batch.num_rows:
                part = _Rows(batch.column("vec_id"), batch.column("label"), _matrix(batch.column("v")))
                far = _distances(part.v, part.sizes, own.sample.v[:pivots], own.top, is_anchor)
                cell = far.argmin(axis=1)
                columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name, "d"])

    return rows.select("vec_id", "label", "v", "place").mapInArrow(run, f"{ROW}, {name} int, d double")


def _packed(pdf: pd.DataFrame) -> _Rows:
    return _Rows(pdf["vec_id"], pdf["label"], pdf["v"].to_numpy())


def _meeting(asking: DataFrame, rows: DataFrame, wanted: DataFrame, keys: list[str], path: str):
    """Groups of anchors in each of their blocks, and rows in a block of each group whose bound they meet; cogrouped.

    wanted: grp, `keys`, least, and n, the rows there: a group has at most their sum.
    """
    wanted = common.written(wanted, path)
    blocks = wanted.groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(wanted.join(blocks, "grp").select("grp", *keys, "least", "blocks"), keys).filter(F.col("d") >= F.col("least"))
    placed = placed.select("grp", F.pmod(F.xxhash64("vec_id", "place"), "blocks").cast("int").alias("block"), "vec_id", "label", "v")
    dealt = asking.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.groupBy("grp", "block").cogroup(placed.groupBy("grp", "block"))


def mine(vectors: DataFrame, anchors: str, positives: int = POSITIVES, negatives: int = NEGATIVES, span: tuple[int, int] = RANGE, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label and `embedding`, whose components become floor(scale * x); anchors: a condition on vec_id.
    An anchor's positives are the best `positives` other rows of its label; for each of them come the best `negatives`
    rows of other labels whose score is from span[0] to span[1] hundredths of the positive's. Ties go to the smaller id.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component or one beyond 2**20 when
    scaled take no part; nor do those of another length than the smallest id's. A candidate that repeats an id is a row
    of its own, also as a positive; an id asks once, with the least of its labels and vectors, and rows of its own id
    aren't its positives. Positive scores below 0 have an empty range. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    with common.scratch(spark) as path:
        rows = common.written(_whole(vectors, scale), f"{path}/rows")
        first = rows.orderBy("vec_id", "label", "v").select("dim").head()
        rows = rows.filter(F.col("dim") == (first["dim"] if first else 0))
        n, top = rows.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).head()
        sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()  # bounded by SAMPLE
        pivots = max(1, min(PIVOTS, n // ROWS_A_PIVOT))
        space = spark.sparkContext.broadcast(_Space(_Rows(*([r[c] for r in sampled] for c in ("vec_id", "label", "v"))), pivots, int(top)))
        base = common.written(_assigned(rows, space, pivots, "cell", False), f"{path}/cells")
        sizes = common.written(base.groupBy("cell", "label").agg(F.count("*").alias("n"), F.max("d").alias("most")), f"{path}/sizes")

        # groups of anchors: coarse cells, the large ones cut by a hash
        ids = base.filter(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_r")).select("vec_id", "_r.*", F.lit(0).alias("place"))
        ids = common.written(ids, f"{path}/anchors")
        near = common.written(_assigned(ids, space, max(1, min(len(sampled), ids.count() // GROUP)), "near", True), f"{path}/near")
        parts = near.groupBy("near").agg(F.ceil(F.count("*") / (2 * GROUP)).cast("int").alias("parts"))  # at most a row per sampled one
        asking = near.join(F.broadcast(parts), "near").select((F.col("near").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), "parts")).alias("grp"), "vec_id", "label", "v")
        asking = common.written(asking, f"{path}/groups")

        def bounds_of_labels(keys, pdf):
            return pd.DataFrame([(keys[0], label, needs) for label, needs in _first_bounds(space.value, _packed(pdf), positives)], columns=["grp", "label", "needs"])

        def local_positives(left, right):
            a, r = _packed(left), _packed(right)
            return pd.DataFrame([(a.ids[i], r.ids[j], s) for i, j, s in positives_of(a, r, positives)], columns=["anchor_id", "positive_id", "score"])

        bounds = asking.groupBy("grp").applyInPandas(bounds_of_labels, "grp long, label long, needs array<double>")
        wanted = bounds.join(sizes, "label").withColumn("least", F.col("needs")[F.col("cell")]).filter("most >= least").select("grp", "cell", "label", "least", "n")
        found = _meeting(asking, base, wanted, ["cell", "label"], f"{path}/wanted").applyInPandas(local_positives, "anchor_id long, positive_id long, score long")
        order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id")
        kept = found.withColumn("p", F.row_number().over(order)).filter(F.col("p") <= positives)
        known = kept.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("p", "positive_id", "score"))).alias("_p"))  # at most `positives` each
        asking = asking.join(known, "vec_id").select("grp", "vec_id", "label", "v", F.col("_p.positive_id").alias("p_ids"), F.col("_p.score").alias("p_scores"))
        asking = common.written(asking, f"{path}/positives")

        def bounds_of_ranges(keys, pdf):
            found = _second_bounds(space.value, _packed(pdf), pdf["p_scores"].to_list(), negatives, span)
            return pd.DataFrame([(keys[0], needs) for needs in found], columns=["grp", "needs"])

        def local_negatives(left, right):
            a, r = _packed(left), _packed(right)
            ids, scores = left["p_ids"].to_list(), left["p_scores"].to_list()
            out = [(a.ids[i], p, ids[i][p], r.ids[j], scores[i][p], s) for i, p, j, s in negatives_of(a, scores, r, negatives, span)]
            return pd.DataFrame(out, columns=["anchor_id", "p", "positive_id", "negative_id", "positive_score", "negative_score"])

        cells = sizes.groupBy("cell").agg(F.sum("n").alias("n"), F.max("most").alias("most"))  # at most a row per pivot
        bounds = asking.groupBy("grp").applyInPandas(bounds_of_ranges, "grp long, needs array<double>").select("grp", F.posexplode("needs").alias("cell", "least"))
        wanted = bounds.join(F.broadcast(cells), "cell").filter("most >= least").select("grp", "cell", "least", "n")
        schema = "anchor_id long, p int, positive_id long, negative_id long, positive_score long, negative_score long"
        found = _meeting(asking, base, wanted, ["cell"], f"{path}/wanted2").applyInPandas(local_negatives, schema)
        order = Window.partitionBy("anchor_id", "p").orderBy(F.col("negative_score").desc(), "negative_id")
        out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        return common.cut(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
