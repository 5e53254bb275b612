"""Shared handling of vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column, dim: int) -> Column:
    """True when the vector has ``dim`` finite numbers, not all zero; never null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column without nulls as float64 rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by their largest entry, so that no square overflows)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lists(x: np.ndarray, dtype=np.float32) -> pa.Array:
    """Rows as an Arrow list column."""
    flat = np.ascontiguousarray(x, dtype=dtype).ravel()
    offsets = np.arange(0, len(flat) + 1, x.shape[1] if x.ndim == 2 and x.shape[1] else 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
