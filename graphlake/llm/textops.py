"""Words of whole text columns as 64-bit hashes, vectorised over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20_240_601)
#: Random values of the bytes, A-Z like a-z, and an odd base with its inverse modulo 2**64.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = int(_RNG.integers(1, 1 << 62)) * 4 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes of text that are hashed at once; a longer single text is hashed alone.
CHUNK = 1 << 19
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, CHUNK + 1), np.uint64)
        have[0] = 1
        have[1:] = base & 0xFFFFFFFFFFFFFFFF
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_slice(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each word's row, and each row's number of words; `ends`: where each row's text ends in `data`."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    word = ~_SPACE[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[0] = True
    begins[ends] = True
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & (~before | begins[:n]))
    stop = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | begins[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * _powers(_INVERSE, n)[start] + (stop - start).astype(np.uint64))
    row = np.searchsorted(ends, start, side="right")
    return hashes, row, np.bincount(row, minlength=len(ends))


def word_hashes(texts: pa.StringArray):
    """Yields (first row, hashes, row of each word from there, words per row) over slices of a text column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
        hi = min(hi, len(texts))
        hashes, row, count = _hash_slice(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo])
        yield lo, hashes, row, count
        lo = hi


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, count: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `words` words and their rows; a shorter row has its whole sequence as its only one."""
    n = len(hashes)
    if not n:
        return hashes, row
    first = np.cumsum(count) - count
    place = np.arange(n) - first[row]
    length = np.minimum(count[row] - place, words)
    keep = (place + words <= count[row]) | ((place == 0) & (count[row] < words))
    at = np.flatnonzero(keep)
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        has = length[at] > k
        part = hashes[np.minimum(at + k, n - 1)]
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(has, part, np.uint64(0)) + np.uint64(k))
    return out, row[at]


def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, rows in order, each row's hashes sorted; `row` ascends.

    One sort by the row and the upper bits of the hash; rows in which different hashes share these are sorted in full.
    """
    if not len(hashes):
        return hashes, row
    width = np.uint64(max(1, int(row[-1]).bit_length()))
    order = np.argsort(row.astype(np.uint64) << (np.uint64(64) - width) | hashes >> width)
    hashes, row = hashes[order], row[order]
    if np.any((hashes[1:] < hashes[:-1]) & (row[1:] == row[:-1])):
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
    fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])
    return hashes[fresh], row[fresh]
