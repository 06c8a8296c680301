"""Comparison of two evaluators' relations with annotated ones, on the same pairs of claim and document.

The three inputs meet in one aggregate by pair, which also shows where their keys differ. Metrics are resampled by claim: all
pairs of a claim are drawn together, as they aren't independent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.gating import unique_argmax
from evidra.operators.fusion import CLAIM
from evidra.operators.resampling import auroc_resamples, compared, label_scores

RELATIONS = ("support", "refute", "unknown")
PAIR = [*CLAIM, "doc_id"]
SIDES = ("oracle", "reference", "rival")


def _met(oracle: DataFrame, reference: DataFrame, rival: DataFrame) -> DataFrame:
    """One row for each pair of any input: how often each has it, and its probabilities."""
    p = [f"p_{k}" for k in RELATIONS]
    rows = reduce(DataFrame.unionByName, (df.select(*PAIR, F.lit(s).alias("_side"), *p) for s, df in zip(SIDES, (oracle, reference, rival), strict=True)))
    of = lambda s, x: F.when(F.col("_side") == s, x)
    return rows.groupBy(*PAIR).agg(*(F.count(of(s, F.lit(1))).alias(f"n_{s}") for s in SIDES), *(F.max(of(s, F.col(c))).alias(f"{s}_{c}") for s in SIDES for c in p))


def pair_violations(oracle: DataFrame, reference: DataFrame, rival: DataFrame) -> DataFrame:
    """(pair, n_oracle, n_reference, n_rival) of pairs that an input lacks, or has several times."""
    return _met(oracle, reference, rival).filter(" OR ".join(f"n_{s} <> 1" for s in SIDES)).select(*PAIR, *(f"n_{s}" for s in SIDES))


def paired(oracle: DataFrame, reference: DataFrame, rival: DataFrame) -> DataFrame:
    """(pair, probabilities and the relation that leads, as <input>_top, of all three). A pair that an input lacks or has
    several times is an error as it is read."""
    wrong = reduce(lambda a, b: a | b, (F.col(f"n_{s}") != 1 for s in SIDES))
    said = F.concat(F.lit("the inputs don't have the same pairs: "), F.concat_ws("/", *(F.col(c).cast("string") for c in PAIR)), *(x for s in SIDES for x in (F.lit(f", {s} "), F.col(f"n_{s}").cast("string"))))
    tops = {f"{s}_top": F.when(wrong, F.raise_error(said).cast("string")).otherwise(unique_argmax({k: F.col(f"{s}_p_{k}") for k in RELATIONS})) for s in SIDES}
    return _met(oracle, reference, rival).withColumns(tops)


def relation_comparison(oracle: DataFrame, reference: DataFrame, rival: DataFrame, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """(metric, reference, rival, both values, delta, low, high, p_value, n_resamples) on the pairs whose annotation has one
    leading relation: accuracy and Macro-F1 of the leading relation (none counts as wrong), and the AUROC of each relation's
    probability."""
    rows = paired(oracle, reference, rival).filter("oracle_top IS NOT NULL")
    said = rows.select(*CLAIM, F.col("oracle_top").alias("gold_state"), *(F.coalesce(f"{s}_top", F.lit("tie")).alias(s) for s in SIDES[1:]))
    labels = label_scores(said, [], list(SIDES[1:]), CLAIM, resamples, seed, list(RELATIONS)).withColumnRenamed("side", "name").select("metric", "name", "resample", "value")
    cell = lambda k, s: F.struct(F.lit(f"auroc_{k}").alias("metric"), F.lit(s).alias("name"), F.round(f"{s}_p_{k}", 9).alias("score"), (F.col("oracle_top") == k).cast("int").alias("positive"))
    scores = rows.select(*CLAIM, F.explode(F.array(*(cell(k, s) for k in RELATIONS for s in SIDES[1:]))).alias("x")).select(*CLAIM, "x.*")
    ranks = auroc_resamples(scores, resamples, seed, ["metric", "name"], CLAIM).withColumnRenamed("auroc", "value")
    return compared(labels.unionByName(ranks), ["metric"], "reference")


def relation_counts(oracle: DataFrame, reference: DataFrame, rival: DataFrame) -> DataFrame:
    """(input, relation, n): how often each relation leads (or tie) among the pairs with one leading annotation; input
    agreement counts over all pairs whether both evaluators say the same (agree, differ)."""
    rows = paired(oracle, reference, rival)
    same = F.when(F.col("reference_top").eqNullSafe(F.col("rival_top")), "agree").otherwise("differ")
    said = F.when(F.col("oracle_top").isNotNull(), F.array(*(F.struct(F.lit(s).alias("input"), F.coalesce(f"{s}_top", F.lit("tie")).alias("relation")) for s in SIDES))).otherwise(F.array())
    cells = F.concat(said, F.array(F.struct(F.lit("agreement").alias("input"), same.alias("relation"))))
    return rows.select(F.explode(cells).alias("x")).groupBy("x.input", "x.relation").agg(F.count("*").alias("n"))
