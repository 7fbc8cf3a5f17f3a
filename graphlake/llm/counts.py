"""In how many rows hashes occur over a whole table, in cells: at least as many as in truth, and the same for all who ask.

Tasks count their own rows and the parts are added by segment. A count is kept as a level, one byte on a logarithmic
scale, of which 0 and 1 are exact. So levels, with the hash to break ties, put all hashes into one order that needs no
shuffle of what is counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bloom, common

SEGMENT = 1 << 20
#: A table of levels is broadcast: 32 MB at most.
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 25
#: Hashes that a task holds before it counts them.
HELD = 1 << 21


def cells_for(hashes: int) -> int:
    """Cells that keep most of so many hashes apart, where the bound allows it."""
    return min(MAX_CELLS, max(MIN_CELLS, common.pow2_at_least(4 * hashes)))


def _parts(hashes_of: Callable[[pa.RecordBatch], np.ndarray], cells: int):
    def packed(places: list[np.ndarray]):
        places, counts = np.unique(np.concatenate(places), return_counts=True)
        edges = np.searchsorted(places, np.arange(0, cells + 1, SEGMENT, dtype=np.uint64))
        for segment in np.flatnonzero(np.diff(edges)):
            own = slice(edges[segment], edges[segment + 1])
            both = np.stack([places[own] % np.uint64(SEGMENT), counts[own].astype(np.uint64)]).astype("<u4")
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int64()), "cells": [zlib.compress(both.tobytes(), 1)]})

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(bloom.places_of(hashes_of(batch), cells)[1])
            if sum(map(len, held)) >= HELD:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    return run


def _level(counts: np.ndarray) -> np.ndarray:
    return np.where(counts < 2, counts, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(counts, 1))))).astype(np.uint8)


def _added(batches) -> Iterator[pa.RecordBatch]:
    """The levels of rows sorted by segment, one segment in memory at a time."""
    current, sums = None, np.zeros(SEGMENT, np.int64)

    def done():
        return pa.RecordBatch.from_pydict({"segment": pa.array([current], pa.int64()), "levels": [zlib.compress(_level(sums).tobytes(), 1)]})

    for batch in batches:
        for segment, packed in zip(batch.column("segment").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            if segment != current:
                if current is not None:
                    yield done()
                current = segment
                sums[:] = 0
            places, counts = np.frombuffer(zlib.decompress(packed), "<u4").reshape(2, -1)
            sums[places] += counts
    if current is not None:
        yield done()


def counted(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], cells: int) -> bytes:
    """The levels of all cells; `hashes_of` gives a batch's hashes, each once for a row that has it."""
    parts = df.mapInArrow(_parts(hashes_of, cells), "segment long, cells binary")
    levels = np.zeros(cells, np.uint8)
    for row in parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_added, "segment long, levels binary").toLocalIterator():
        levels[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(row["levels"]), np.uint8)
    return levels.tobytes()


def levels_of(hashes: np.ndarray, levels: bytes) -> np.ndarray:
    table = np.frombuffer(levels, np.uint8)
    return table[bloom.places_of(hashes, len(table))[1].astype(np.int64)]
