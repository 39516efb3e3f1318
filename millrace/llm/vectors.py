"""Vectors as integer matrices: which rows take part, and how Arrow lists become arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers beyond this saturate, so that they and their doubles are exact.
LARGEST = float(1 << 52)


def dimension(df: DataFrame, vector_col: str) -> int:
    """The length that most non-null vectors have (of equally frequent ones the largest); 0 if there is none."""
    sizes = df.filter(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0


def usable(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows that take part and ``floor(1024 * entry)`` of their vectors as whole doubles.

    Null vectors, vectors with null or non-finite entries and vectors of another length than ``d`` take no part.
    """
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == d)
    if not len(at) or not d:
        return at[:0], np.zeros((0, d))
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    finite = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        return at[finite], np.clip(np.floor(values[finite] * 1024), -LARGEST, LARGEST)
