"""List columns of Arrow as NumPy vectors, and back."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

NUMBERS = pa.list_(pa.float64())


def vectors(column: pa.ListArray | pa.ChunkedArray) -> list[np.ndarray]:
    """A vector for each list; nulls inside become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def lists(parts: Iterable[np.ndarray]) -> pa.ListArray:
    parts = list(parts)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.asarray(flat, float)))


def repeated(values: Iterable, times: Iterable[int], kind: pa.DataType) -> pa.Array:
    return pa.array([v for v, n in zip(values, times) for _ in range(n)], kind)
