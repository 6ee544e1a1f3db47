"""Vectors as exact integers, in blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Vectors of a block: with 64 components, half a megabyte.
BLOCK = 1024


def scaled(vectors: pa.Array, scale: int, most=lambda n: (2.0**55 / max(n, 1)) ** 0.5) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: the places of usable vectors in ``vectors``, and floor(scale * x) of their components.

    Not usable: null vectors, and vectors with a null or non-finite component or a scaled one
    beyond ``most`` of their number of components (by default, inner products stay below 2 ** 55).
    """
    vectors = vectors.cast(pa.large_list(pa.float64()))
    flat, ends = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    there = np.flatnonzero(np.asarray(vectors.is_valid()))
    sizes, out = np.diff(ends)[there], {}
    for n in np.unique(sizes).tolist():
        at = there[sizes == n]
        codes = np.floor(flat[ends[at][:, None] + np.arange(n)] * float(scale))
        able = (np.abs(codes) <= most(n)).all(1)  # false for NaN and infinities
        if able.any():
            out[n] = at[able], codes[able].astype(np.int64)
    return out


def int_rows(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``size`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)
