"""Vectors of Arrow columns as integer matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def scaled(column: pa.Array, size: int, scale: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of `size` components, and floor(scale * x) of each.

    Null vectors and those with null or non-finite components are left out. An integer
    beyond `most` is an error, as sums over it would not be exact.
    """
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    places = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype(np.float64).reshape(len(places), size)
    finite = np.isfinite(matrix).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.floor(matrix[finite] * scale)
    if whole.size and np.abs(whole).max() > most:
        raise ValueError(f"a component times {scale} lies beyond {most}")
    return places[finite], whole.astype(np.int64)


def packed(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.dtype.itemsize * matrix.shape[1]
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(matrix), buffers)


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The matrix that `packed` wrote."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)
