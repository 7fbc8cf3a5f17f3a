"""Vector codes: each of a vector's parts becomes the index of the nearest entry of that part's codebook.

Codebooks are whole numbers, so results don't depend on how rows are dealt. They start as the parts of the vectors with
the smallest ids and are broadcast (parts x entries x width numbers, whatever the table's size). In each round a task
takes its Arrow batches, finds the nearest entries by norms and exact matrix products, and adds up its own rows by
entry, so that a task gives at most a row per entry; these meet in a grouped shuffle, and the driver gets one row per
entry to make the next codebooks of. Nothing but the codebooks passes from round to round: a lost executor's tasks read
their part of the table again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .vectors import exact_product, whole_rows

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to all entries are in memory at once.
SLICE = 4_096
#: Sums of so many labels are broadcast; of more they are joined by shuffle.
BROADCAST_LABELS = 100_000


class Codebooks:
    """`entries`: int64, parts x entries x width of a part."""

    def __init__(self, entries: np.ndarray, scale: int = SCALE):
        self.entries, self.scale = entries, scale

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Digest of all components in decimal by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's entry per part, the first of equally near ones, and its squared distances summed over parts."""
        codes, error = np.empty((len(x), len(self.entries)), np.int64), np.zeros(len(x), np.int64)
        width = self.entries.shape[2]
        for p, book in enumerate(self.entries):
            own = x[:, p * width : (p + 1) * width]
            # |x - c|^2 without |x|^2, which is the same for all entries
            far = (book * book).sum(axis=1) - 2 * exact_product(own, book)
            codes[:, p] = far.argmin(axis=1)
            error += far[np.arange(len(x)), codes[:, p]] + (own * own).sum(axis=1)
        return codes, error

    def decode(self, codes: DataFrame, column: str = "code") -> DataFrame:
        """Adds `decoded`: the entries that a code names, in the scale of the vectors."""
        books = codes.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def entries_of(code):
            digits = np.array([list(bytes.fromhex(c)) for c in code], np.int64).reshape(len(code), -1)
            own = books.value.entries[np.arange(digits.shape[1]), digits] if len(digits) else np.zeros((0, 0, 0))
            return pd.Series(list(own.reshape(len(digits), -1) / books.value.scale))

        return codes.withColumn("decoded", entries_of(F.col(column)))


def _slices(batches, books: Codebooks, columns: tuple[str, ...] = ()):
    """The rows of the codebooks' length, some at a time, with the other columns of these rows."""
    for batch in batches:
        for at, x in whole_rows(batch.column("_v"), books.scale):
            if x.shape[1] == books.length:
                for lo in range(0, len(x), SLICE):
                    own = batch.take(pa.array(at[lo : lo + SLICE]))
                    yield [own.column(c) for c in columns], x[lo : lo + SLICE]


def first_entries(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks:
    """Codebooks of the parts of the usable vectors with the smallest ids; each task gives no more rows than entries."""

    def run(batches):
        for batch in batches:
            for at, x in whole_rows(batch.column("_v"), scale):
                if x.shape[1] % parts == 0:
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "v"])

    rows = vectors.select("vec_id", F.col("embedding").alias("_v")).mapInArrow(run, "vec_id long, v array<long>")
    smallest = lambda df: [r["v"] for r in df.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]  # noqa: E731  bounded: as many as a codebook has entries
    first = smallest(rows)
    length = len(first[0]) if first else 0
    if any(len(v) != length for v in first):
        first = smallest(rows.filter(F.size("v") == length))
    matrix = np.array(first, np.int64).reshape(len(first), parts, length // parts)
    return Codebooks(np.ascontiguousarray(matrix.transpose(1, 0, 2)), scale)


def refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round; entries that no part is assigned to stay."""
    parts, entries, width = books.entries.shape
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(books)

    def run(batches):
        own = sent.value
        sums, counts = np.zeros(own.entries.shape, np.int64), np.zeros(own.entries.shape[:2], np.int64)
        for _, x in _slices(batches, own):
            for p, code in enumerate(own.nearest(x)[0].T):
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                sums[p, used] += np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
                counts[p] += np.bincount(code, minlength=entries)
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(sums.reshape(-1, width)[at]), pa.list_(pa.int64())), pa.array(counts.ravel()[at])], names=["entry", "sums", "n"])

    rows = vectors.select(F.col("embedding").alias("_v")).mapInArrow(run, "entry long, sums array<long>, n long")
    merged = rows.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).alias("sums"))
    out = books.entries.reshape(-1, width).copy()
    for row in merged.collect():  # one row per entry
        out[row["entry"]] = np.array(row["sums"], np.int64) // row["n"]
    sent.destroy()
    return Codebooks(out.reshape(parts, entries, width), books.scale)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of floor(scale * x) of `embedding` after so many rounds; all rows count in each of them.

    Rows whose vector is null or empty, holds a null or non-finite component or one beyond 2**20 when scaled take no
    part, and neither do vectors whose length isn't a multiple of `parts` or isn't that of the smallest id's. Null ids
    come after all others, rows that repeat an id stand in the order of their vectors, and each is a row of its own.
    With fewer rows than entries each is an entry; of an empty table the codebooks are empty.
    """
    books = first_entries(vectors, parts, entries, scale)
    for _ in range(rounds if books.length else 0):
        books = refined(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """The columns in `keep`, code (two hex digits a part) and error (squared distance) of each row that train() takes.

    At most 256 entries. Names in `keep` may be any; repeated rows stay; an empty table gives an empty result.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    own = tuple(f"_k{i}" for i in range(len(keep)))
    src = vectors.select(*(F.col(c).alias(k) for c, k in zip(keep, own, strict=True)), F.col("embedding").alias("_v"))
    schema = ", ".join([*(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in own), "code string", "error long"])

    def run(batches):
        for columns, x in _slices(batches, sent.value, own):
            codes, error = sent.value.nearest(x)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string()), pa.array(error)], names=[*own, "code", "error"])

    return src.mapInArrow(run, schema).select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), "code", "error")


def with_label_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error: the error summed over rows of equal label, nulls together.

    Sums are made before they are shuffled. Few labels are broadcast; else both sides of the join are plain tables, so
    that a hot label's rows may be split.
    """
    rows = common.cut(codes)
    sums = common.cut(rows.groupBy(F.col(label).alias("_l")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col(label).eqNullSafe(F.col("_l")), "left").drop("_l")
