"""Embedding columns as exact integers and as NumPy blocks, for the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scaled component beyond this isn't taken for an exact integer.
MOST = 2.0**52


def usable(vector: Column) -> Column:
    """The vector isn't null and has no component that is null, NaN or infinite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int, shift: int = 0) -> Column:
    """Components, as doubles, times scale, floored and shifted, as longs; beyond 2**52 an error."""

    def one(c: Column) -> Column:
        x = c.cast("double") * scale
        return F.when(F.abs(x) <= MOST, F.floor(x) + shift).otherwise(F.raise_error(F.format_string("component %s is too large", c)).cast("long"))

    return F.transform(vector, one)


def most_common_size(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have (of as frequent ones the largest); 0 without a vector."""
    found = rows.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return found["n"] if found else 0


def block(column: pa.Array, size: int) -> np.ndarray:
    """(rows, size) of an Arrow column of lists of that size without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
