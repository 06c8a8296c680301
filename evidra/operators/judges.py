"""A judge's labels of claims: what it answered, what that cost, and how it compares with a run's methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.fusion import CLAIM
from evidra.operators.metrics import classification_report
from evidra.operators.resampling import GOLD, bootstrap_interval, paired_bootstrap


def judged(claims: DataFrame, answers: DataFrame, labels: list[str] = GOLD) -> DataFrame:
    """A row for each claim (sample_id, claim_id, gold_state) with its answer (label, refused, input_tokens, output_tokens) and
    status: valid, invalid (a label that isn't one of labels, or a refusal) or missing. A claim that is answered twice, and an
    answer to no claim, are errors as they are read."""
    by = answers.groupBy(*CLAIM).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in ("label", "refused", "input_tokens", "output_tokens")))
    met = claims.select(*CLAIM, "gold_state", F.lit(True).alias("_own")).join(by, CLAIM, "full")
    said = F.concat_ws("/", *(F.col(c).cast("string") for c in CLAIM))
    wrong = F.when(F.col("_own").isNull(), F.raise_error(F.concat(F.lit("an answer to no claim: "), said)).cast("string")).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two answers to "), said)).cast("string"))
    valid = F.col("label").isin(labels) & ~F.coalesce("refused", F.lit(False))
    return met.withColumn("status", F.coalesce(wrong, F.when(F.col("_n").isNull(), "missing").when(F.coalesce(valid, F.lit(False)), "valid").otherwise("invalid"))).drop("_own", "_n")


def accounts(rows: DataFrame) -> DataFrame:
    """(status, label, claims, refused, input_tokens, output_tokens) of judged(); what has no valid label counts under null."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    label = F.when(F.col("status") == "valid", F.col("label"))
    return rows.groupBy("status", label.alias("label")).agg(F.count("*").alias("claims"), total(F.col("refused").cast("int")).alias("refused"), total(F.col("input_tokens")).alias("input_tokens"), total(F.col("output_tokens")).alias("output_tokens"))


def report(rows: DataFrame, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """(metric, observed, low, high, n_resamples, n_claims, macro over gold labels) of the valid answers of judged()."""
    said = rows.filter("status = 'valid'").withColumn("predicted", F.col("label"))
    plain = classification_report(said.withColumn("_one", F.lit(1)), ["_one"]).select(F.col("macro_f1").alias("macro_f1_of_present"))
    return bootstrap_interval(said, resamples, seed, CLAIM).crossJoin(F.broadcast(plain))


def compare_with_run(rows: DataFrame, run: DataFrame, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """(method, metric, difference, low, high, p_value, n_resamples, n_claims): the judge less each method of a run (method,
    claim, predicted), on the claims that the judge has a valid answer for. A claim of those that a method lacks or has twice
    is an error as it is read."""
    own = rows.filter("status = 'valid'").select(*CLAIM, "gold_state", F.col("label").alias("predicted_a"))
    methods = run.select("method").distinct()
    theirs = run.groupBy("method", *CLAIM).agg(F.count("*").alias("_n"), F.first("predicted").alias("predicted_b"))
    met = own.crossJoin(F.broadcast(methods)).join(theirs, ["method", *CLAIM], "left")
    lost = F.raise_error(F.concat(F.lit("not one prediction of "), F.concat_ws("/", "method", *(F.col(c).cast("string") for c in CLAIM)))).cast("string")
    met = met.withColumn("predicted_b", F.when(F.coalesce("_n", F.lit(0)) == 1, F.col("predicted_b")).otherwise(lost))
    return paired_bootstrap(met, resamples, seed, CLAIM, ["method"])
