"""Vectors of Arrow batches as matrices of whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scaled components beyond this aren't taken: below it sums of 64-bit products stay exact up to 2**12 dimensions.
LIMIT = 1 << 20


def whole_rows(column: pa.Array, scale: int, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, floor(scale * x) as int64) of the rows that are fit for use, one pair per length of vectors.

    Unfit are null and empty vectors and those with a null, non-finite or scaled component beyond `limit`.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(size))  # nulls become NaN
        with np.errstate(invalid="ignore", over="ignore"):
            y = np.floor(x * scale)
            fine = (np.abs(y) <= limit).all(axis=1)  # false for NaN and infinities
        if fine.any():
            yield at[fine], y[fine].astype(np.int64)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int64 matrix product a @ b.T; by doubles where no partial sum can leave the whole numbers they hold."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
