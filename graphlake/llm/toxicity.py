"""Toxicity from subword bags: character n-gram embeddings, averaged per stretch of words, into a linear softmax.

Embeddings and softmax are trained jointly in numpy on a bounded sample of labelled documents. A word is the mean of
its n-gram vectors, and the document's logit is the soft maximum of its words', so that a few toxic words count in a
text of any length. As every unseen spelling is a
bag of n-grams too, it shares vectors with the words it resembles. For scoring, the two trained layers fold into one
number per n-gram bucket, which is broadcast (its size is fixed by BUCKETS).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents of label 0 and 1 that are fitted, at most.
TRAIN_ROWS = (3_000, 1_000)
BUCKETS, DIM = 1 << 18, 4
GRAMS = (3, 4, 5, 6)
#: Words of the sample that an n-gram must be part of to be fitted.
MIN_WORDS = 6
THRESHOLD = 0.7
#: How close the soft maximum is to the maximum.
SHARPNESS = 2.0
#: Characters of scored text that are in memory at once.
CHUNK = 1 << 20
#: Words whose n-grams are listed at once, and n-grams summed at once.
SLICE, SUMMED = 1 << 14, 1 << 18
_LETTERS = re.compile("[0-9A-Za-zÀ-῿⁰-⿿぀-\U0010ffff]+")


def _letters(cp: np.ndarray) -> np.ndarray:
    ascii_ok = ((cp >= 48) & (cp <= 57)) | ((cp >= 65) & (cp <= 90)) | ((cp >= 97) & (cp <= 122))
    return ascii_ok | ((cp >= 0xC0) & (cp < 0x2000)) | ((cp >= 0x2070) & (cp < 0x3000)) | (cp >= 0x3040)


def _code(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each after a separator (0 for all that isn't a letter), and where each begins."""
    low = ["\n" + t.lower() for t in texts]
    cp = np.frombuffer("".join([*low, "\n" * max(GRAMS)]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters(cp), cp, 0).astype(np.uint32), np.cumsum([0, *map(len, low)])


def _buckets(code: np.ndarray):
    """For each n: the bucket of the n-gram at each position, BUCKETS where there is none."""
    n_all = len(code) - max(GRAMS)
    letter = code != 0
    h, inner = code[:n_all].copy(), np.ones(n_all, dtype=bool)
    for n in range(2, max(GRAMS) + 1):
        h = h * np.uint32(0x01000193) + code[n - 1 : n - 1 + n_all]
        if n > 2:
            inner &= letter[n - 2 : n - 2 + n_all]
        if n in GRAMS:
            x = h ^ (h >> np.uint32(15)) ^ np.uint32(n)
            x = x * np.uint32(0x85EBCA6B)
            yield np.where(inner, (x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1), np.uint32(BUCKETS))


def _soft_max(logits: np.ndarray, doc_of: np.ndarray, docs: int, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Soft maximum of the logits of each document's words; -inf where it has none."""
    top = np.full(docs, -np.inf)
    np.maximum.at(top, doc_of, logits)
    total = np.bincount(doc_of, weight * np.exp(SHARPNESS * (logits - top[doc_of])), docs)
    with np.errstate(divide="ignore"):
        return np.where(total > 0, top + np.log(np.maximum(total, 1e-300)) / SHARPNESS, -np.inf)


class Model:
    """`weights`: what each bucket adds to a word's sum (0 at BUCKETS); `bias`: of a word's mean; `shift`: of the score."""

    def __init__(self, weights: np.ndarray, bias: float, shift: float = 0.0):
        self.weights, self.bias, self.shift = weights, bias, shift

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each text."""
        out = np.empty(len(texts))
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                size, hi = size + len(texts[hi]), hi + 1
            out[lo:hi] = self._score(texts[lo:hi])
            lo = hi
        return out

    def _score(self, texts: list[str]) -> np.ndarray:
        code, begins = _code(texts)
        n_all = len(code) - max(GRAMS)
        letter = code != 0
        doc = np.repeat(np.arange(len(texts)), np.diff(begins))
        begun = letter[1 : n_all + 1] & ~letter[:n_all]  # at the separator before each word
        begun[begins[:-1]] = True  # what stands before a document's first word is a bag without n-grams, or that word's own
        edge = np.flatnonzero(begun)
        total, count = np.zeros(len(edge)), np.zeros(len(edge))
        for b in _buckets(code):
            total += np.add.reduceat(self.weights[b], edge, dtype=np.float64)
            count += np.add.reduceat((b != BUCKETS).astype(np.int32), edge)
        logits = np.where(count > 0, total / np.maximum(count, 1), 0.0) + self.bias
        s = _soft_max(logits, doc[edge], len(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


class Bags:
    """Words of labelled documents, taken in batch by batch: what is kept is each document's distinct words and their counts."""

    def __init__(self):
        self.vocabulary: dict[str, int] = {"": 0}  # the empty word, which every document has
        self.words, self.times, self.sizes, self.labels = [], [], [], []

    def add(self, counts: dict[str, int], label: float) -> None:
        own = {0: 1} | {self.vocabulary.setdefault(w, len(self.vocabulary)): n for w, n in counts.items() if w}
        self.words.append(np.fromiter(own, np.int32, len(own)))
        self.times.append(np.fromiter(own.values(), np.float32, len(own)))
        self.sizes.append(len(own))
        self.labels.append(label)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all n-grams of the vocabulary, the word of each, and how many a word has; words a slice at a time."""
        listed, parts, count = list(self.vocabulary), [], np.zeros(len(self.vocabulary), np.int64)
        for lo in range(0, len(listed), SLICE):
            code, begins = _code(listed[lo : lo + SLICE])
            owner = np.repeat(np.arange(lo, min(lo + SLICE, len(listed)), dtype=np.int32), np.diff(begins))
            for b in _buckets(code):
                ok = b != BUCKETS
                parts.append((b[ok].astype(np.int32), owner[ok]))
                count += np.bincount(owner[ok], minlength=len(listed))
        gram, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        return gram, owner, count


def word_counts(text: str) -> Counter:
    return Counter(_LETTERS.findall(text.lower()))


def _sums(at: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each column of `values`, the sums of its entries `of` by `at`; so few at a time that no long copy is made."""
    out = np.zeros((n, values.shape[1]), np.float64)
    for lo in range(0, len(at), SUMMED):
        a, o = at[lo : lo + SUMMED], of[lo : lo + SUMMED]
        for k in range(values.shape[1]):
            out[:, k] += np.bincount(a, values[:, k][o], n)
    return out.astype(np.float32)


def fit_bags(bags: Bags, prior: float | None = None, epochs: int = 80, seed: int = 7) -> Model:
    """Trains embeddings and softmax jointly by Adam over the whole sample; `prior`: share of label 1 outside of it.

    With no text, or one label only, the model is constant.
    """
    labels = np.asarray(bags.labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        p = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        return Model(np.zeros(BUCKETS + 1, np.float32), float(np.log(p / (1 - p))))
    words, times, doc_of = np.concatenate(bags.words), np.concatenate(bags.times), np.repeat(np.arange(len(labels), dtype=np.int32), bags.sizes)
    docs, n_words = len(labels), len(bags.vocabulary)
    gram, owner, count_of = bags.grams()
    often = np.bincount(gram, minlength=BUCKETS) >= MIN_WORDS  # n-grams of a few words tell nothing about others
    used = np.flatnonzero(often)
    kept = often[gram]
    gram, owner = (np.cumsum(often) - 1).astype(np.int32)[gram[kept]], owner[kept]
    count = np.maximum(count_of, 1).astype(np.float32)[:, None]
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (len(used), DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, w, bias)]
    for step in range(1, epochs + 1):
        mean = _sums(owner, e, gram, n_words) / count
        logits = mean @ w + bias
        margin = (logits[:, 1] - logits[:, 0]).astype(np.float64)[words]
        score = _soft_max(margin, doc_of, docs, times)
        p = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        g = ((p - labels) / docs)[doc_of] * times * np.exp(SHARPNESS * (margin - score[doc_of]))
        g = np.bincount(words, g, n_words)
        two = np.stack([-g, g], axis=1).astype(np.float32)
        g_e = _sums(gram, (two @ w.T) / count, owner, len(used))
        for (m, v), x, grad, rate in zip(state, (e, w, bias), (g_e + 1e-7 * e, mean.T @ two, two.sum(0)), (0.15, 0.05, 0.1), strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS + 1, np.float32)
    weights[used] = e @ (w[:, 1] - w[:, 0])
    own = labels.mean()
    shift = 0.0 if prior is None else float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)) - np.log(own / (1 - own)))
    return Model(weights, float(bias[1] - bias[0]), shift)


def fit(texts: list[str], labels: np.ndarray, prior: float | None = None, epochs: int = 80, seed: int = 7) -> Model:
    """As fit_bags, for texts in memory."""
    bags = Bags()
    for text, label in zip(texts, labels, strict=True):
        bags.add(word_counts(text), float(label))
    return fit_bags(bags, prior, epochs, seed)


def held_out(doc_id) -> object:
    """Whether a row's label is kept from training: crc32 of its id as text leaves 1 when divided by 3 (null: '')."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3) == 1


def _counted(batches):
    """Distinct words of each text and how often each occurs, in place of the text."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            counts = [word_counts(t or "") for t in part.column("_text").to_pylist()]
            words = pa.array([list(c) for c in counts], pa.list_(pa.string()))
            times = pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label"), words, times], names=["_id", "_label", "words", "times"])


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: tuple[int, int] = TRAIN_ROWS) -> DataFrame:
    """_id, _label, words, times: at most rows[label] documents of each label, chosen by a hash of the id, none held out.

    Words are counted where the texts are. Of rows that repeat an id one is taken, by a hash of its text; of labels
    that differ for an id, the larger.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(rows[value])
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select("doc_id", common.text_or_empty().alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # sum(rows) ids at most
    once = found.groupBy("_id").agg(F.min_by(F.struct("_label", "_text"), F.xxhash64("_text")).alias("_r")).select(F.col("_id").cast("string").alias("_id"), "_r.*")
    return once.mapInArrow(_counted, "_id string, _label int, words array<string>, times array<int>")


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns in `keep`, score (0 to 1) and predicted (score >= threshold), for every row.

    Null text is empty text, which has the score of a document without words. Equal texts have equal scores, rows that
    repeat an id are rows of their own, and an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [f"_k{i}" for i in range(len(keep))]  # so that no name in `keep` clashes
    src = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, own, strict=True)), F.col("text").alias("_text"))
    schema = ", ".join([*(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in own), "score double", "predicted int"])

    def run(batches):
        for batch in batches:
            s = sent.value.score([x or "" for x in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in own), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*own, "score", "predicted"])

    return src.mapInArrow(run, schema).select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), "score", "predicted")


def _fitted(batches):
    bags = Bags()
    for batch in batches:
        for words, times, label in zip(*(batch.column(n) for n in ("words", "times", "_label")), strict=True):
            bags.add(dict(zip(words.as_py(), times.as_py(), strict=True)), float(label.as_py()))
    model = fit_bags(bags)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.shift])], names=["weights", "bias", "shift"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: tuple[int, int] = TRAIN_ROWS) -> Model:
    """Fits a model to labels of `docs` that are not held out.

    One task of the cluster fits it, as the sample is bounded; the driver gets one number per bucket (1 MB).
    """
    with common.small_batches(docs.sparkSession):
        sample = training_sample(docs, labels, label, rows).repartition(1).sortWithinPartitions("_id")
        rows_of = sample.mapInArrow(_fitted, "weights binary, bias double, shift double").collect()
    if not rows_of:  # of an empty table no task may be left
        return fit_bags(Bags())
    row = rows_of[0]
    return Model(np.frombuffer(row["weights"], np.float32).copy(), row["bias"], row["shift"])
