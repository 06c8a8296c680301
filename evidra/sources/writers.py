"""Sinks. Spark commits a folder as a whole; nothing is overwritten unless told so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the flat files, in order.
PIPELINE_COLUMNS = [
    "sample_id", "claim_id", "claim_text", "status", "context_count", "evaluators", "m_support", "m_refute", "m_theta", "k_doc", "k_eval", "region",
    "verdict", "primary_state", "evidence_insufficient", "document_conflict", "evaluator_disagreement", "gold_state",
]
BASELINE_COLUMNS = ["sample_id", "claim_id", "method", "evaluator", "score_support", "score_refute", "score_unknown", "predicted_state", "reason", "input_count", "gold_state"]


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


#: Lines of a JSON file at most: files.artifact() has a whole file in a task for its digest.
FILE_LINES = 100_000


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False, compression: str = "none") -> None:
    """Files of FILE_LINES lines at most. Whatever reads them tells a compression (as gzip) by their names."""
    df.write.mode(_mode(overwrite)).option("maxRecordsPerFile", FILE_LINES).json(path, compression=compression)


def pipeline_rows(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Diagnosed claims with the text of each claim and the number of its sample's contexts, as write_pipeline_csv() takes
    them. samples: nested rows."""
    flat = samples.select("sample_id", F.explode("claims").alias("c"), F.size("contexts").alias("context_count"))
    return results.join(flat.select("sample_id", F.col("c.claim_id").alias("claim_id"), F.col("c.text").alias("claim_text"), "context_count"), ["sample_id", "claim_id"])


def write_pipeline_csv(results: DataFrame, path: str, overwrite: bool = False, compression: str = "none") -> None:
    """Diagnosed claims as flat rows; evaluators are joined by |, null is empty. A column that results lack is an error."""
    flat = results.withColumn("evaluators", F.concat_ws("|", "evaluators"))
    flat.select(*PIPELINE_COLUMNS).write.mode(_mode(overwrite)).option("header", True).csv(path, compression=compression)


def write_samples(samples: DataFrame, path: str, overwrite: bool = False, compression: str = "none") -> None:
    write_jsonl(samples.select("sample_id", "question", "answer", "reference_answer", "claims", "contexts", "gold_state"), path, overwrite, compression)


def write_relations(relations: DataFrame, path: str, overwrite: bool = False, compression: str = "none") -> None:
    write_jsonl(relations.select("sample_id", "claim_id", "doc_id", "evaluator", "p_support", "p_refute", "p_unknown", "evaluator_reliability"), path, overwrite, compression)


def write_baseline_csv(decisions: DataFrame, path: str, evaluator: str, overwrite: bool = False, compression: str = "none") -> None:
    """run_baselines() rows; evaluator is that of single_evaluator."""
    named = decisions.withColumn("evaluator", F.when(F.col("method") == "single_evaluator", evaluator)).withColumnRenamed("state", "predicted_state")
    named.select(*BASELINE_COLUMNS).write.mode(_mode(overwrite)).option("header", True).csv(path, compression=compression)


def main_results(reports: DataFrame, classes: DataFrame, detection: DataFrame) -> DataFrame:
    """A row for each method and class: its reports (method, accuracy, macro_f1, n), class_metrics() by method, and detection
    reports (method, name: insufficiency or conflict)."""
    side = lambda n: detection.filter(F.col("name") == n).select("method", F.col("auroc").alias(f"{n}_auroc"), F.col("average_precision").alias(f"{n}_auprc"), F.col("best_f1").alias(f"{n}_best_f1"))
    whole = reports.select("method", "accuracy", "macro_f1", F.col("n").alias("sample_count"))
    return whole.join(classes.select("method", "label", "precision", "recall", "f1", "support"), "method").join(side("insufficiency"), "method", "left").join(side("conflict"), "method", "left")


def ablation_rows(report: DataFrame, theta: float, document_conflict: float, evaluator_conflict: float) -> DataFrame:
    """experiments.ablation() with the thresholds that it was made with."""
    return report.select("variant", "accuracy", "macro_f1", F.col("delta").alias("macro_f1_delta"), F.col("vacuous").alias("is_vacuous"), F.lit(theta).alias("theta_threshold"), F.lit(document_conflict).alias("document_conflict_threshold"), F.lit(evaluator_conflict).alias("evaluator_conflict_threshold"), F.col("n").alias("sample_count"))


def checking_inputs(samples: DataFrame) -> DataFrame:
    """(query_id, query, response, retrieved_context) as a checking model takes them."""
    return samples.select(F.col("sample_id").alias("query_id"), F.col("question").alias("query"), F.col("answer").alias("response"), F.transform("contexts", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["text"].alias("text"))).alias("retrieved_context"))


def calibration_points(long: DataFrame, method: str) -> DataFrame:
    """(theta, k_doc, gold_state) of a method's predictions: what a scatter of both gates shows."""
    return long.filter(F.col("method") == method).select(F.col("insufficiency_score").alias("theta"), F.col("conflict_score").alias("k_doc"), "gold_state")


def write_predictions_csv(predictions: DataFrame, path: str, overwrite: bool = False) -> None:
    rows = predictions.withColumn("correct", (F.col("predicted_label") == F.col("gold_label")).cast("int"))
    rows.write.mode(_mode(overwrite)).option("header", True).csv(path)


def write_table_csv(table: DataFrame, path: str, overwrite: bool = False) -> None:
    """A result table with its doubles rounded to six places."""
    rounded = [F.bround(c, 6).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes]
    table.select(*rounded).write.mode(_mode(overwrite)).option("header", True).csv(path)
