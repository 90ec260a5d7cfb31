"""Vectors as whole numbers: how components are kept, floored and read in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def largest(dim: int) -> int:
    """The largest power of two that components may reach so that squared distances of dim components fit a long."""
    return 1 << ((61 - (dim - 1).bit_length()) // 2)


def complete(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def floored(vector: Column, scale: int, dim: int) -> Column:
    """array<int>: floor(scale * x) of each component, no further from zero than `largest` allows."""
    most = largest(dim)
    whole = lambda x: F.least(F.greatest(F.floor(x * F.lit(float(scale))), F.lit(-most)), F.lit(most)).cast("int")
    return F.transform(vector.cast("array<double>"), whole)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column, all of dim whole numbers, as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def floor_means(sums: list[list[int]], counts: list[int], before: np.ndarray) -> np.ndarray:
    """Componentwise exact floor(sum / count); where nothing was counted, what was there before."""
    return np.array([[x // n for x in s] if n else b for s, n, b in zip(sums, counts, before.tolist(), strict=True)], np.int64).reshape(before.shape)
