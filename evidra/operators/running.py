"""Running sums over an order, without a task that sees all rows of a key.

Rows are dealt to buckets that follow one another in the order; each bucket is summed by a window of its own, and what the
buckets before it add is a small table. A value that many rows share has a bucket for itself, which a second column of
the order splits further. Small inputs are one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.tables import kept

#: Estimated bytes of an input up to which one bucket does, and buckets beyond. Estimates follow the compressed files (42 MB
#: were 9 million claims), and one bucket is one task.
ONE_BUCKET, BUCKETS = 16 << 20, 256


def is_large(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > ONE_BUCKET


def once(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """df, and whether it is large: then it is kept, so that edges() and what follows don't each work it out anew."""
    large = is_large(df)
    return (kept(df, name), True) if large else (df, False)


def edges(df: DataFrame, column: str, buckets: int = BUCKETS, large: bool | None = None) -> list[float]:
    """Values of a column that part it evenly; none for a small input. large says which it is, where it isn't estimated."""
    if not (is_large(df) if large is None else large):
        return []
    return sorted(set(df.approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.2 / buckets)))


def bucket(column: Column, at: list[float], then: Column | None = None, then_at: list[float] | None = None) -> Column:
    """A struct that follows the column's order: odd first numbers are for values equal to an edge, and there the second
    follows another column."""
    if not at:
        return F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    below = lambda x, values: F.size(F.filter(F.lit(values), lambda e: e < x)) if values else F.lit(0)
    equal = F.array_contains(F.lit(at), column.cast("double"))
    second = F.when(equal, below(then, then_at)).otherwise(0) if then is not None else F.lit(0)
    return F.struct((2 * below(column, at) + equal.cast("int")).alias("a"), second.alias("b"))


def running(df: DataFrame, keys: list[str], place: Column, order: list[Column], sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """df with sums (name: what is summed) from the first row of its keys (not null) up to each row, in an order of rows
    that place, a bucket(), follows."""
    by = df.withColumn("_b", place)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = by.groupBy(*keys, "_b").agg(*(F.sum(c).alias(f"_all_{n}") for n, c in sums.items()))
    one = [] if keys else [F.lit(1).alias("_one")]
    upto = Window.partitionBy(*(keys or ["_one"])).orderBy(F.desc("_b") if descending else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = total.select("*", *one).select(*keys, "_b", *(F.coalesce(F.sum(f"_all_{n}").over(upto), F.lit(0)).alias(f"_before_{n}") for n in sums))
    out = by.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()}).join(before, [*keys, "_b"])
    return out.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_b", *(f"_before_{n}" for n in sums))
