"""Vectors as rows of integers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def width_of(rows: DataFrame, order: str, vector: str) -> int:
    """Components of the first vector in order; 0 without one."""
    first = rows.orderBy(order, vector).select(F.size(vector)).first()
    return first[0] if first else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of `width` doubles each as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


def blobs(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of an array, as a binary column."""
    n, data = len(rows), np.ascontiguousarray(rows)
    each = data[0].nbytes if n else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * each).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def unblob(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    """The inverse of blobs: rows of `shape`."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind).reshape(len(column), *shape)
