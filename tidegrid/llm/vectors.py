"""Vectors as rows: which take part, equal ones as one, and batches as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component, not empty."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def keys(*columns: Column) -> list[Column]:
    """96 bits that stand for equal values."""
    return [F.xxhash64(*columns).alias("key"), F.hash(*columns).alias("key2")]


def matrix(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of an Arrow list column: per dimension (dimension, row numbers, matrix of doubles)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        at = (ends[rows] - size)[:, None] + np.arange(size)
        out.append((int(size), rows, flat[at]))
    return out


def sample(vectors: DataFrame, rows: int, values: int = 4_000_000) -> np.ndarray:
    """At most ``rows`` unit vectors of the commonest dimension, by hash, and at most ``values`` numbers.

    The bound makes the collection safe; the same vectors come in every run.
    """
    common = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return np.zeros((0, 0))
    size = common["n"]
    some = vectors.filter(F.size("embedding") == size).orderBy("key", "key2").select("embedding").limit(min(rows, max(1, values // size)))
    found = np.array([r[0] for r in some.collect()], np.float64).reshape(-1, size)
    return found / np.linalg.norm(found, axis=1)[:, None]
