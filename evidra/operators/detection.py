"""How well scores detect conflict and insufficiency: fusion's own, and proxies that need no fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.fusion import CLAIM
from evidra.operators.metrics import detection_report
from evidra.operators.resampling import auroc_resamples, compared

#: The name of fusion's score in either task, and the state that a task detects.
OWN, TASKS = "ds", {"conflict": "conflicting", "insufficiency": "insufficient"}


def proxies() -> dict[str, dict]:
    """Of each task the proxies as columns of stat_gate_scores()."""
    a, b = F.col("score_support"), F.col("score_refute")
    return {
        "conflict": {
            "one_minus_abs_margin": 1 - F.abs(a - b), "min_mean": F.least(a, b), "mean_product": a * b, "max_product": F.col("conflict_max_product"),
            "min_max": F.col("min_max"), "sr_std": F.col("conflict_sr_std"), "document_count": F.col("document_count").cast("double"),
        },
        "insufficiency": {"mean_unknown": F.col("score_unknown"), "min_unknown": F.col("min_unknown"), "unknown_product": F.col("insufficiency_uprod")},
    }


def _cells(columns: dict[str, dict]):
    cell = lambda task, name, x: F.struct(F.lit(task).alias("task"), F.lit(name).alias("name"), F.round(x, 9).alias("score"), (F.col("gold_state") == TASKS[task]).cast("int").alias("positive"))
    return F.explode(F.array(*(cell(task, name, x) for task, of in columns.items() for name, x in of.items())))


def fused_rows(results: DataFrame) -> DataFrame:
    """(task, name, claim, score, positive) of diagnosed claims: k_doc for conflict, m_theta (0 if undefined) for
    insufficiency."""
    own = {"conflict": {OWN: F.col("k_doc")}, "insufficiency": {OWN: F.coalesce("m_theta", F.lit(0.0))}}
    return results.select(*CLAIM, _cells(own).alias("x")).select("x.task", "x.name", *CLAIM, "x.score", "x.positive")


def proxy_rows(scores: DataFrame) -> DataFrame:
    """(task, name, claim, score, positive) of the seven conflict and three insufficiency proxies, from stat_gate_scores()."""
    return scores.select(*CLAIM, _cells(proxies()).alias("x")).select("x.task", "x.name", *CLAIM, "x.score", "x.positive")


def compare_detection(results: DataFrame, scores: DataFrame, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """(task, reference, rival, both AUROC, delta, low, high, p_value, n_resamples): fusion's score less each proxy, paired on
    resampled claims; resamples of one class are left out of n_resamples."""
    rows = fused_rows(results).unionByName(proxy_rows(scores))
    found = auroc_resamples(rows, resamples, seed, ["task", "name"], CLAIM)
    return compared(found.withColumnRenamed("auroc", "value"), ["task"], OWN).withColumnsRenamed({"value_reference": "auroc_reference", "value_rival": "auroc_rival"})


def auroc_by_document_count(results: DataFrame, contexts: DataFrame, least: int = 40, least_class: int = 8) -> DataFrame:
    """(documents, auroc, n): fusion's conflict among claims with equally many documents, where these are enough and of both
    classes; no rows if all claims have as many."""
    number = contexts.groupBy("sample_id").agg(F.count("*").alias("documents"))
    rows = results.join(number, "sample_id").select("documents", F.round("k_doc", 9).alias("score"), (F.col("gold_state") == "conflicting").cast("int").alias("positive"))
    # the report has a row for each number, so nothing is joined or read again to count these
    found = detection_report(rows, ["documents"]).withColumn("_kinds", F.count("*").over(Window.partitionBy(F.lit(0))))
    enough = (F.col("n") >= least) & (F.col("positives") >= least_class) & (F.col("n") - F.col("positives") >= least_class)
    return found.filter((F.col("_kinds") > 1) & enough).select("documents", "auroc", "n")
