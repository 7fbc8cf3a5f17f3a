"""Best-fit packing of tokenized documents into fixed-length sequences.

Documents are tokenized and cut where they are longer than a sequence. The pieces are dealt by a hash into shards of
a bounded number; each shard runs best-fit decreasing on its own. A segment tree over remaining capacities counts
the open bins of each capacity, so the tightest bin that still fits is found by one descent, in logarithmic time. A
shard leaves at most its last bins unfilled, which costs less than one sequence in a few hundred.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TOKENS = 1024
END_OF_TEXT = 2
SHARD_PIECES = 20_000
#: Below this code point letters, digits and spaces are the same in every Unicode version.
_STABLE = 0x250
#: Fixed value: how the byte-level vocabulary splits text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class FreeSpace:
    """Segment tree over the capacities 0..size with the number of open bins at each; the bins wait in stacks."""

    def __init__(self, size: int):
        self.leaves = common.pow2_at_least(size + 1)
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, bin_id: int) -> None:
        self.bins[capacity].append(bin_id)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a bin of the smallest capacity >= least; returns (capacity, bin)."""
        count, node = self.count, least + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until the right sibling has a bin
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not count[2 * node])
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int = MAX_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1..size); ties keep the given order."""
    free, bins = FreeSpace(size), 0
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-np.asarray(lengths), kind="stable"):
        n = int(lengths[i])
        found = free.take(n)
        if found is None:
            found, bins = (size, bins), bins + 1
        capacity, at[i] = found
        offset[i] = size - capacity
        if capacity > n:
            free.add(capacity - n, int(at[i]))
    return at, offset


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str | None):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    if not ranks_path:
        return whole, None, special
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return whole, tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def encode(texts: list[str], json_path: str, ranks_path: str | None = None) -> list[list[int]]:
    """Ids of each text as the tokenizer at `json_path` gives them.

    With `ranks_path` (the same vocabulary as ranks) texts whose characters all Unicode versions class alike and that
    hold no special token go through the faster library, which gives the same ids; all others stay with the first.
    """
    whole, fast, special = _encoders(json_path, ranks_path)
    out: list = [None] * len(texts)
    slow = []
    for i, text in enumerate(texts):
        if fast and (text.isascii() or ord(max(text)) < _STABLE) and not any(s in text for s in special):
            out[i] = fast._core_bpe.encode_ordinary(text)
        else:
            slow.append(i)
    for i, e in zip(slow, whole.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
        out[i] = e.ids
    return out


def _tokenize(json_path: str, ranks_path: str | None, size: int, end: int, names: list[str], with_ids: bool):
    def run(batches):
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                texts = [x or "" for x in batch.column("_text").to_pylist()]
                row, piece, start, length, crc, ids_out = [], [], [], [], [], []
                for i, ids in enumerate(encode(texts, json_path, ranks_path)):
                    ids.append(end)
                    data = np.array(ids, dtype="<u4")
                    edges = [0, *range((len(data) - 1) % size + 1, len(data) + 1, size)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        row.append(i), piece.append(k), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(data[a:b].tobytes()))
                        if with_ids:
                            ids_out.append(data[a:b].astype(np.int64))
                taken = batch.select(names).take(pa.array(row, pa.int64()))
                cols = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                extra = [pa.array(ids_out, pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*taken.columns, *cols, *extra], names=[*names, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return run


def tokenize(docs: DataFrame, json_path: str, ranks_path: str | None = None, size: int = MAX_TOKENS, end: int = END_OF_TEXT, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Pieces of at most `size` tokens: doc_id, `keep`, piece, start, length, ids_crc32, and the ids on request.

    Each document's ids end with `end`, so a null or empty text is one piece of length 1. The first piece of a longer
    document holds what is left over, the others are full.
    """
    names = ["doc_id", *keep]
    src = docs.select(*names, F.col("text").alias("_text"))
    schema = ", ".join(f"`{n}` {src.schema[n].dataType.simpleString()}" for n in names)
    schema += ", piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return src.mapInArrow(_tokenize(json_path, ranks_path, size, end, names, with_ids), schema)


def about_pieces(docs: DataFrame, size: int = MAX_TOKENS) -> int:
    """About how many pieces the documents make, from the lengths of their texts (three characters a token)."""
    row = docs.agg(F.sum(1 + F.floor(F.coalesce(F.length("text"), F.lit(0)) / F.lit(3 * size))).alias("n")).first()
    return int(row["n"] or 0)


def pack(pieces: DataFrame, rows: int, size: int = MAX_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (`rows`: about how many there are, which gives the number of shards).

    Only lengths decide; equal rows are packed as rows of their own, and an empty table gives an empty result. The result doesn't depend on the order of input
    rows but for which of several pieces of one length goes where.
    """
    shards = max(1, -(-rows // shard_pieces))
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_shard").sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        at, offset = best_fit_decreasing(pdf["length"].to_numpy(), size)
        return pdf.assign(sequence_id=at + (int(keys[0]) << 32), offset=offset)

    return pieces.withColumn("_shard", key).groupBy("_shard").applyInPandas(run, schema)
