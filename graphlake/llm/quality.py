"""Quality from trusted positives and unlabelled text: a linear model under the non-negative unbiased risk.

There are texts that are trusted to be good and texts of which nothing is known; no negative label is used. With prior
p, the share of good texts among the unlabelled, the risk of a scorer g is

    p * E_good[loss(g)] + max(0, E_all[loss(-g)] - p * E_good[loss(-g)])

whose second term is what the bad texts among the unlabelled cost; it can't be below 0 in truth, so where a batch makes
it so the step goes the other way. The prior comes from the same rows: a first scorer is fitted to tell good from
unlabelled on one half; on the other half, the share of unlabelled texts above a threshold, over that of good ones, is
at least the prior for every threshold; the best of these bounds, allowing for chance, is taken.

A text's features don't grow with it: frequencies of runs of character classes in BUCKETS cells and how far its words
repeat. They are computed where the texts are; one task of the cluster fits the bounded sample of feature rows.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textops

#: Good and unlabelled documents that are fitted, at most.
TRAIN_ROWS = (4_000, 8_000)
THRESHOLD = 0.3
#: Cells of runs of classes, lengths of these runs, and further features: repeats of words, distinct words, length.
BUCKETS, RUNS, MORE = 1_024, (1, 2, 3), 4
WIDTH = BUCKETS + MORE
#: Characters whose features are made at once; a longer text is taken in pieces.
CHUNK = 1 << 19


@cache
def _classes() -> np.ndarray:
    """The class of each code point below 0x10000, those above being symbols: small and capital letters, other letters,
    digits, marks, spaces, line ends, and each ASCII sign by itself."""
    kinds = {"Ll": 1, "Lu": 2, "Lt": 2, "Lm": 3, "Lo": 3, "Nd": 4, "Mn": 5, "Mc": 5, "Zs": 6}
    out = np.array([kinds.get(unicodedata.category(chr(c)), 7) for c in range(0x10000)] + [7], np.uint32)
    out[[9, 32]], out[[10, 13]] = 6, 8
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[signs] = 9 + np.arange(len(signs))
    return out


def _counts(texts: list[str]) -> np.ndarray:
    """Runs of classes of each text, by cell."""
    sizes = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[np.minimum(code, 0x10000)]
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters to the text's end, this one included
    out, h = np.zeros(len(texts) * BUCKETS, np.int64), np.zeros(len(code), np.uint32)
    for n in RUNS:
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + kind[n - 1 :]
        x = (h ^ np.uint32(n)) * np.uint32(0x85EBCA6B)
        inside = left[: len(h)] >= n
        out += np.bincount(row[: len(h)][inside] * BUCKETS + (x >> np.uint32(22)).astype(np.int64)[inside], minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


def _repeats(texts: pa.Array) -> np.ndarray:
    """Per text: words, words like the one before, distinct words and distinct runs of five."""
    out = np.zeros((len(texts), 4))
    for lo, hashes, row, count in textops.word_hashes(texts):
        own = out[lo : lo + len(count)]
        own[:, 0] = count
        own[:, 1] = np.bincount(row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=len(count))
        own[:, 2] = np.bincount(textops.distinct(hashes, row)[1], minlength=len(count))
        own[:, 3] = np.bincount(textops.distinct(*textops.shingle_hashes(hashes, row, count, 5))[1], minlength=len(count))
    return out


def features(texts: pa.Array) -> np.ndarray:
    """float32, a row per text; null is empty text. Equal texts have equal rows."""
    listed = [t or "" for t in texts.to_pylist()]
    pieces = [(i, t[lo : lo + CHUNK]) for i, t in enumerate(listed) for lo in range(0, max(len(t), 1), CHUNK)]
    counts, at = np.zeros((len(listed), BUCKETS)), 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= CHUNK):
            size, end = size + len(pieces[end][1]), end + 1
        np.add.at(counts, [i for i, _ in pieces[at:end]], _counts([t for _, t in pieces[at:end]]))
        at = end
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    repeats = _repeats(texts.cast(pa.string()))
    words = np.maximum(repeats[:, :1], 1)
    more = np.concatenate([repeats[:, 1:3] / words, repeats[:, 3:] / np.maximum(words - 4, 1), np.log1p(repeats[:, :1]) / 10], axis=1)
    return np.concatenate([np.sqrt(counts / total), np.minimum(more, 1.5)], axis=1).astype(np.float32)


class Model:
    """A linear scorer of features, and the prior that it was fitted with."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margins(x).astype(np.float64), -50, 50)))


def _descend(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    """Weights and, at the end, the bias after so many steps of Adam."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _through(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sigmoids of the scorer's margins."""
    return _sigmoid((x @ w[:-1].astype(np.float32)).astype(np.float64) + w[-1])


def _mean(x: np.ndarray, by_row: np.ndarray) -> np.ndarray:
    """The mean of rows weighted by `by_row`, and of the weights."""
    return np.append(by_row.astype(np.float32) @ x, by_row.sum()) / len(x)


def non_negative(good: np.ndarray, every: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Minimises the non-negative risk with logistic loss."""

    def gradient(w):
        g, e = _through(good, w), _through(every, w)
        # loss(-g) is log(1 + exp(g)); its slope is the sigmoid
        bad_risk = np.mean(-np.log1p(-np.minimum(e, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(g, 1 - 1e-12)))
        bad = _mean(every, e) - prior * _mean(good, g)
        if bad_risk < 0:
            return -bad
        return prior * _mean(good, g - 1) + bad + decay * np.append(w[:-1], 0)

    w = _descend(gradient, good.shape[1], steps, rate)
    return Model(w[:-1].astype(np.float32), float(w[-1]), prior)


def estimated_prior(good: np.ndarray, every: np.ndarray, sure: float = 0.1) -> float:
    """The share of good rows among `every`; halves are taken by turns, and both serve once for fitting."""
    found = []
    for turn in (0, 1):
        (g, h), (e, f) = ((x[turn::2], x[1 - turn :: 2]) for x in (good, every))
        if not (len(g) and len(h) and len(e) and len(f)):
            continue
        w = _descend(lambda w, g=g, e=e: _mean(g, _through(g, w) - 1) + _mean(e, _through(e, w)), g.shape[1], 150, 0.1)
        of_good, of_every = (np.sort(x @ w[:-1].astype(np.float32)) for x in (h, f))
        cuts = np.unique(of_good)
        share = lambda s: 1 - np.searchsorted(s, cuts, "left") / len(s)
        above, kept = share(of_every), share(of_good)
        chance = np.sqrt(np.log(4 / sure) / 2 / len(f)) + np.sqrt(np.log(4 / sure) / 2 / len(h))
        best = int(np.argmin((above + 1.01 * chance) / kept))
        found.append(above[best] / kept[best])
    return float(np.clip(np.mean(found), 0.01, 0.99)) if found else 0.5


def fit(good: np.ndarray, every: np.ndarray) -> Model:
    """From feature rows; without good or other rows the model is constant."""
    prior = estimated_prior(good, every)
    if not len(good) or not len(every):
        return Model(np.zeros(WIDTH, np.float32), float(np.log(prior / (1 - prior))), prior)
    return non_negative(good, every, prior)


def held_out(doc_id) -> object:
    """Whether a row's label is kept from training: crc32 of its id as text is divisible by 5 (null: '')."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5) == 0


def _featured(batches):
    for batch in batches:
        x = features(batch.column("_text"))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_good"), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "_good", "x"])


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: tuple[int, int] = TRAIN_ROWS) -> DataFrame:
    """_id, _good, x: at most rows[0] documents labelled 1 and rows[1] others whose labels aren't looked at.

    Both are chosen by a hash of the id, and none is held out. Of rows that repeat an id one is taken, by a hash of its
    text; an id that is labelled both 0 and 1 isn't trusted. Only chosen ids are broadcast.
    """
    free = lambda df: df.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumnRenamed("doc_id", "_id")
    trusted = free(labels.filter(F.col(label).isNotNull()).select("doc_id", label)).groupBy("_id").agg(F.min(label).alias("_l")).filter("_l = 1").select("_id", F.lit(1).alias("_good"))
    every = free(docs.select("doc_id")).distinct().select("_id", F.lit(0).alias("_good"))
    first = lambda df, n, seed: df.orderBy(F.xxhash64(F.col("_id"), F.lit(seed)), "_id").limit(n)
    chosen = first(trusted, rows[0], 1).unionByName(first(every, rows[1], 2))
    found = docs.select("doc_id", common.text_or_empty().alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # sum(rows) ids at most
    once = found.groupBy("_id", "_good").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    return once.select(F.col("_id").cast("string").alias("_id"), "_good", "_text").mapInArrow(_featured, "_id string, _good int, x binary")


def _fitted(batches):
    rows: tuple[list, list] = ([], [])
    for batch in batches:
        for good, x in zip(batch.column("_good").to_pylist(), batch.column("x").to_pylist(), strict=True):
            rows[good].append(np.frombuffer(x, np.float32))
    every, good = (np.stack(r) if r else np.zeros((0, WIDTH), np.float32) for r in rows)
    model = fit(good, every)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.prior])], names=["weights", "bias", "prior"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: tuple[int, int] = TRAIN_ROWS) -> Model:
    """Fits a model to documents labelled 1 and to unlabelled ones, none of them held out.

    One task of the cluster fits the sample, at most sum(rows) rows of WIDTH numbers; the driver gets the weights. With
    no label 1, or an empty table, the model is constant.
    """
    with common.small_batches(docs.sparkSession):
        sample = training_sample(docs, labels, label, rows).repartition(1).sortWithinPartitions("_good", "_id")
        found = sample.mapInArrow(_fitted, "weights binary, bias double, prior double").collect()
    if not found:  # of an empty table no task may be left
        return fit(np.zeros((0, WIDTH), np.float32), np.zeros((0, WIDTH), np.float32))
    return Model(np.frombuffer(found[0]["weights"], np.float32).copy(), found[0]["bias"], found[0]["prior"])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns in `keep`, score (0 to 1) and predicted (score >= threshold), for every row.

    Null text is empty text. Equal texts have equal scores, rows that repeat an id are rows of their own, texts of any
    length are read whole, in pieces, and an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [f"_k{i}" for i in range(len(keep))]  # so that no name in `keep` clashes
    src = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, own, strict=True)), F.col("text").cast("string").alias("_text"))
    schema = ", ".join([*(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in own), "score double", "predicted int"])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                s = sent.value.score(features(part.column("_text")))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in own), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*own, "score", "predicted"])

    return src.mapInArrow(run, schema).select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), "score", "predicted")
