"""Draws that depend on nothing but a row's key and a counter, as columns that any SQL engine can repeat.

A key's digest gives two words of 31 bits; these and the counter are mixed by sums, products and shifts within 63 bits, so
no engine's overflow or hash is met. The same numbers come from SQL: see plans/oracle.py.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words' range and the mixing's step and factors.
WORD, STEP, FIRST, SECOND = 2**31, 1367130551, 739982445, 695872825
#: A word below the kth of these is a Poisson draw (mean 1) of k at most.
CUTS = [int(WORD * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(10)]


def words(*key: Column) -> tuple[Column, Column]:
    """Two words of a key: its columns as text, with a slash between them."""
    digest = F.md5(F.concat_ws("/", *(k.cast("string") for k in key)))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long").bitwiseAND(F.lit(WORD - 1))
    return word(1), word(9)


def _mixed(df: DataFrame) -> DataFrame:
    """df with _x mixed. Each step is a projection of its own: within one, _x would be written out twice at each shift."""
    for shift, factor in ((15, FIRST), (12, SECOND), (15, None)):
        df = df.withColumn("_x", F.col("_x").bitwiseXOR(F.shiftright("_x", shift)))
        if factor:
            df = df.withColumn("_x", F.col("_x") * F.lit(factor) % F.lit(WORD))
    return df


def poisson(x: Column) -> Column:
    """How often a row is drawn, from its word in a resample."""
    out = F.when(x < CUTS[0], 0)
    for k, cut in enumerate(CUTS[1:], 1):
        out = out.when(x < cut, k)
    return out.otherwise(len(CUTS)).cast("long")


def resampled(rows: DataFrame, key: list[str], resamples: int, seed: int = 42) -> DataFrame:
    """rows with resample and w: resample -1 has each row once, and each of the others has it w times (0 or more), by a Poisson
    draw of its key. Rows of one key are drawn together. (Filter on w after an aggregate: before it, Spark would write the
    whole of the mixing into the condition.)"""
    a, b = words(*map(F.col, key))
    df = rows.withColumns({"_a": a, "_b": b}).withColumn("resample", F.explode(F.sequence(F.lit(-1), F.lit(resamples - 1))))
    counter = F.col("resample").cast("long") + F.lit(seed * 1_000_003)
    df = _mixed(df.withColumn("_x", (F.col("_a") + counter * F.lit(STEP)) % F.lit(WORD)))
    df = _mixed(df.withColumn("_x", F.col("_x").bitwiseXOR(F.col("_b"))))
    df = df.withColumn("w", F.when(F.col("resample") < 0, F.lit(1).cast("long")).otherwise(poisson(F.col("_x"))))
    return df.drop("_a", "_b", "_x")


def drawn_weights(a: np.ndarray, b: np.ndarray, resample: int, seed: int) -> np.ndarray:
    """The weights w that resampled() gives to rows of words a and b in a resample, for tasks that hold many rows at once."""
    if resample < 0:
        return np.ones(len(a), np.uint8)
    low = np.uint32(WORD - 1)  # products wrap at 2**32, of which WORD is a divisor
    x = (a.astype(np.uint32) + np.uint32((resample + seed * 1_000_003) * STEP % WORD)) & low
    for other in (b.astype(np.uint32), None):
        for shift, factor in ((15, FIRST), (12, SECOND), (15, None)):
            x ^= x >> np.uint32(shift)
            if factor:
                x = (x * np.uint32(factor)) & low
        if other is not None:
            x ^= other
    w = np.zeros(len(x), np.uint8)
    for cut in CUTS:
        w += x >= np.uint32(cut)
    return w
