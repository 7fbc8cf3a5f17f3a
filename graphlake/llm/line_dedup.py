"""Line dedup through two Bloom filters.

Every long line's key is hashed into a filter of keys seen once; a key met again goes to a second filter of keys seen
twice. Tasks fill both for their own lines and the partial filters are merged by segment (what two parts have both
seen once was seen twice). Only lines that the second filter suspects are shuffled, as 128-bit digests, to be counted
exactly and to choose the document that keeps them. The filter is broadcast: its size is a parameter with an upper
bound (`max_bits`), beyond which it only lets more unrepeated lines through to the exact count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom, common

MIN_CHARS = 40
MIN_DOCS = 5
#: Bits of a filter for each document, and the bounds of a filter's size (at most 256 MB is broadcast).
BITS_PER_DOC, MIN_BITS, MAX_BITS = 192, 1 << 20, 1 << 31
_LOWEST = -(1 << 63)


def line_keys(text: str | None) -> list[bytes | None]:
    """For each line its key, or None where the key has fewer than MIN_CHARS code points."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
        long = len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode("utf-8", "replace")) >= MIN_CHARS)
        out.append(key if long else None)
    return out


def _hash(keys) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys if k is not None], dtype=np.uint64)


def _batch_hashes(batch: pa.RecordBatch):
    for text in batch.column(0):
        yield _hash(line_keys(text.as_py()))


def _suspected(keys: list[bytes | None], bitmap: bytes) -> np.ndarray:
    """Indexes of the lines that the filter suspects."""
    at = np.array([i for i, k in enumerate(keys) if k is not None], dtype=np.int64)
    return at[bloom.suspected(_hash(keys), bitmap)]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(bitmap_of):
    def run(batches):
        bitmap = bitmap_of.value
        for batch in batches:
            ids, texts, found = [], [], []
            for doc_id, text_id, text in zip(*(batch.column(n) for n in ("doc_id", "text_id", "text")), strict=True):
                keys = line_keys(text.as_py())
                own = {digest(keys[i]) for i in _suspected(keys, bitmap)}
                found.extend(own)
                ids.extend([doc_id.as_py()] * len(own))
                texts.extend([text_id.as_py()] * len(own))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text_id": pa.array(texts, pa.int64()), "key": pa.array(found, pa.binary())})

    return run


def _rebuild(bitmap_of):
    def run(batches):
        bitmap = bitmap_of.value
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, drop in zip(batch.column("_text"), batch.column("_drop"), strict=True):
                text, drop = text.as_py() or "", drop.as_py()
                if not drop:
                    kept.append(text), lines.append(text.count("\n") + 1), dropped.append(0)
                    continue
                drop, keys, all_lines = set(drop), line_keys(text), text.split("\n")
                gone = {int(i) for i in _suspected(keys, bitmap) if digest(keys[i]) in drop}
                kept.append("\n".join(x for i, x in enumerate(all_lines) if i not in gone))
                lines.append(len(all_lines)), dropped.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["_row", "n_lines", "n_dropped", "kept"]
            )

    return run


def _drops(suspects: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, text_id, key) of the suspected lines that go: keys of `min_docs` rows or more, outside of the largest doc_id.

    Keys of more than a task's even share of the rows, of which there are fewer than tasks, are broadcast, so that their
    rows stay where they are; the others are joined by shuffle.
    """
    exact = suspects.groupBy("key").agg(F.count("*").alias("_n"), F.max("doc_id").alias("_keep"))
    exact = common.cut(exact.filter(F.col("_n") >= min_docs))
    tasks = int(suspects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col("_n") * tasks > suspects.count()
    hot = F.broadcast(exact.filter(is_hot).select("key", "_keep"))
    others = exact.filter(~is_hot).select("key", "_keep")
    both = suspects.join(hot, "key").unionByName(suspects.join(hot, "key", "left_anti").join(others, "key"))
    return both.filter(F.col("doc_id") < F.col("_keep")).select("doc_id", "text_id", "key")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the columns in `keep`, n_lines (before), n_dropped and the `kept` text.

    Keys of at least MIN_CHARS code points that `min_docs` rows hold lose all their lines but those in the rows of the
    largest doc_id. Null or empty text is one empty line. A null doc_id ranks below all others. Rows that repeat a
    doc_id count as rows of their own and share what is dropped. The kept text of a null text is empty. An empty table
    gives an empty result. Columns in `keep` may have any name but those of the result.
    """
    spark = docs.sparkSession
    bits = min(max_bits, max(MIN_BITS, common.pow2_at_least(docs.count() * BITS_PER_DOC)))
    bitmap = spark.sparkContext.broadcast(bloom.seen_twice(docs.select("text"), _batch_hashes, bits))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    # what goes is decided by key and doc_id alone, so a hash of the text only parts the rows of one id, or of none
    text_id = F.xxhash64("text")
    suspects = docs.select(ids.alias("doc_id"), text_id.alias("text_id"), "text").mapInArrow(_suspects(bitmap), "doc_id long, text_id long, key binary")
    drops = _drops(common.cut(suspects), min_docs)
    drops = drops.groupBy(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id")).agg(F.collect_set("key").alias("_drop"))
    row = F.struct(*(F.col(f"`{n}`") for n in ("doc_id", *keep))).alias("_row")
    own = docs.select(row, ids.alias("_own"), text_id.alias("_own_text"), F.col("text").alias("_text"))
    joined = own.join(drops, (F.col("_own") == F.col("_id")) & (F.col("_own_text") == F.col("_text_id")), "left").select("_row", "_text", "_drop")
    schema = T.StructType([joined.schema["_row"], *(T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped")), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_rebuild(bitmap), schema).select("_row.*", "n_lines", "n_dropped", "kept")
