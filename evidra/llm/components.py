"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join; lineage is cut by a table in the shared folder.
The end is where a step changes no link: each row is looked for in the step before. Defined results: loops, repeated links and
links with a null end add nothing; an empty table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm._shared import dropped, written


def _step(links: DataFrame, small: bool) -> DataFrame:
    """links (u > v). Hangs the neighbours of each node, those above it (large) or those below and itself (small), on
    the least of its neighbourhood."""
    if small:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    # the least of a node's neighbours in either direction
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
    return links.join(least, links["v"] == least["w"]).select("u", F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str, name: str = "links", most_steps: int = 60) -> DataFrame:
    """(node, root) of every node in links (long ids a, b); the root is the least node of its component and a row of
    its own."""
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    now = written(pair.distinct(), name)
    for _ in range(most_steps):
        # small-star reads its links twice: they are worked out once
        large = written(_step(now, False), name)
        after = written(_step(large, True), name)
        dropped(large)
        # of two tables of distinct rows, equal ones have as many rows and none that the other lacks
        same = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        dropped(now)
        now = after
        if same:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError(f"no fixpoint after {most_steps} steps")
