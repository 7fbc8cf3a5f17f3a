"""Two Bloom filters over a whole table: hashes seen once, and hashes seen at least twice.

Tasks fill both filters for their own rows; the parts are merged by segment, and what two parts have both seen once
was seen twice. The merged second filter lets through every hash that occurs twice, and few others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT_BITS = 1 << 20
#: Hashes that a task holds, about, before it makes parts of them.
HELD = 1 << 22


def places_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each 64-bit hash in a filter of `bits` (a power of two) bits."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask


def _encode(places: np.ndarray) -> bytes:
    """Sorted places within a segment as their gaps, compressed."""
    gaps = np.diff(places.astype(np.int64), prepend=0)
    wide = len(gaps) and gaps.max() > 0xFFFF
    return zlib.compress((b"\4" if wide else b"\2") + gaps.astype("<u4" if wide else "<u2").tobytes(), 1)


def _decode(data: bytes) -> np.ndarray:
    """The segment's bitmap."""
    raw = zlib.decompress(data)
    mask = np.zeros(SEGMENT_BITS, dtype=bool)
    mask[np.cumsum(np.frombuffer(raw[1:], "<u4" if raw[:1] == b"\4" else "<u2").astype(np.int64))] = True
    return np.packbits(mask, bitorder="little")


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorts `x` in place, which is several times faster here than by hashing."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


PARTS_SCHEMA = "segment long, once binary, twice binary"


def parts(seen: list[np.ndarray], bits: int):
    """A task's once and twice filters of the hashes in `seen`, which is emptied, as rows (segment, once, twice).

    Each is compressed; absent segments are empty.
    """
    hashes = np.concatenate([*seen, np.zeros(0, np.uint64)])
    seen.clear()
    pa.default_memory_pool().release_unused()  # the batches' memory, before more is taken
    hashes.sort()
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
    counts = np.diff(np.append(first, len(hashes)))
    hashes = hashes[first]
    once, twice = (_distinct(np.concatenate(places_of(x, bits))) for x in (hashes, hashes[counts > 1]))
    for segment in _distinct(once // np.uint64(SEGMENT_BITS)):
        lo = segment * np.uint64(SEGMENT_BITS)
        row = []
        for places in (once, twice):
            a, b = np.searchsorted(places, [lo, lo + np.uint64(SEGMENT_BITS)])
            row.append(_encode(places[a:b] - lo))
        yield int(segment), row[0], row[1]


def _parts(hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    def run(batches):
        seen = [h for batch in batches for h in hashes_of(batch)]
        for segment, once, twice in parts(seen, bits):
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int64()), "once": [once], "twice": [twice]})

    return run


def _merge(batches):
    """Merges rows sorted by segment, one segment in memory at a time."""
    current, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_pydict({"segment": pa.array([current], pa.int64()), "twice": [zlib.compress(twice.tobytes(), 1)]})

    for batch in batches:
        for segment, o, t in zip(*(batch.column(n).to_pylist() for n in ("segment", "once", "twice")), strict=True):
            o, t = _decode(o), _decode(t)
            if segment != current:
                if current is not None:
                    yield done()
                current, once, twice = segment, o, t
            else:
                twice |= t | (once & o)
                once |= o
    if current is not None:
        yield done()


def merged(rows: DataFrame, bits: int) -> bytes:
    """The filter of the hashes seen twice or more, from the rows of all tasks' parts."""
    whole = rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment long, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in whole.toLocalIterator():
        x = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        out[row["segment"] * len(x) : (row["segment"] + 1) * len(x)] = x
    return out.tobytes()


def seen_twice(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> bytes:
    """The filter of the hashes that `hashes_of` the table's batches gives twice or more."""
    return merged(df.mapInArrow(_parts(hashes_of, bits), PARTS_SCHEMA), bits)


def suspected(hashes: np.ndarray, bitmap: bytes) -> np.ndarray:
    """Which hashes the filter lets through."""
    table = np.frombuffer(bitmap, np.uint8)
    ok = np.ones(len(hashes), dtype=bool)
    for p in places_of(hashes, len(table) * 8):
        ok &= (table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok
