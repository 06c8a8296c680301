"""Inference in rounds that a crash does not undo.

A run asks a model about pairs. Each round takes the pairs without a valid answer that have attempts left, asks the model
as a function over Arrow batches, and appends its answers, valid or not, to a table in the run's folder. Spark puts a round's
files in place when all of its tasks are done, so a killed round leaves what was there before, and the next run goes on from it. A pair whose answers don't
parse is asked again until its attempts are used up, and then is set aside with its last error. Nothing is overwritten: the
last valid answer of a pair counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.gating import VERBAL_LABELS
from evidra.operators.evaluators import parsed_probabilities
from evidra.sources import files

PAIR = ["sample_id", "claim_id", "doc_id"]
#: What a model adds to a pair: its answer as text, and the tokens that it took.
ANSWER = "answer string, error string, served_model string, input_tokens long, output_tokens long"


def _settings(model: str, digest: str, effort: str | None) -> dict[str, str | None]:
    return {"model": model, "prompt_digest": digest, "effort": effort}


def answers(spark, folder: str) -> DataFrame | None:
    """All answers of a run's rounds so far, None before the first: (pair, round, answer, error, valid, probabilities, ...)."""
    return spark.read.parquet(f"{folder}/rounds") if files.matching(spark, f"{folder}/rounds/part-*") else None


def started(spark, folder: str, model: str, digest: str, effort: str | None = None) -> None:
    """Notes a run's model, prompt and effort beside it; a run of other ones is an error."""
    path, own = f"{folder}/run.json", _settings(model, digest, effort)
    if files.exists(spark, path):
        was = files.read_mapping(spark, path)
        other = [k for k, v in own.items() if was.get(k) != v]
        if other:
            raise ValueError(f"{folder} has answers of another {other[0]}: {was.get(other[0])!r}, not {own[other[0]]!r}")
    else:
        files.write_manifest(spark, own, path)


def state(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
    """(pair, attempts, valid, last_error) of all pairs."""
    if done is None:
        return pairs.select(*PAIR, F.lit(0).cast("long").alias("attempts"), F.lit(False).alias("valid"), F.lit(None).cast("string").alias("last_error"))
    by = done.groupBy(*PAIR).agg(F.count("*").alias("attempts"), F.max("valid").alias("valid"), F.max_by("error", "round").alias("last_error"))
    return pairs.select(*PAIR).join(by, PAIR, "left").select(*PAIR, F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("valid", F.lit(False)).alias("valid"), "last_error")


def pending(pairs: DataFrame, done: DataFrame | None, most: int = 3) -> DataFrame:
    """The pairs without a valid answer that have been asked less than most times."""
    return pairs.join(state(pairs, done).filter(~F.col("valid") & (F.col("attempts") < most)).select(*PAIR), PAIR, "left_semi")


def run_rounds(pairs: DataFrame, model: Callable, folder: str, name: str, digest: str, effort: str | None = None, most: int = 3, parse: Callable = parsed_probabilities) -> DataFrame:
    """Asks until each pair (sample_id, claim_id, doc_id, claim_text, doc_text) has a valid answer or no attempt left, and
    returns state(). model: a function over Arrow batches of pairs that gives each pair's ids with the columns of ANSWER; an
    error that it raises ends the run, after which the same call goes on with what is left. parse: adds p_support, p_refute and
    p_unknown to answers, null where one doesn't parse."""
    spark = pairs.sparkSession
    started(spark, folder, name, digest, effort)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*PAIR).schema)
    for _ in range(most):
        done = answers(spark, folder)
        todo = pending(pairs, done, most)
        if todo.isEmpty():
            break
        number = 0 if done is None else done.agg(F.max("round")).first()[0] + 1
        asked = parse(todo.mapInArrow(model, f"{kinds}, {ANSWER}"), "answer")
        valid = F.col("error").isNull() & F.col("p_support").isNotNull()
        said = F.when(~valid, F.coalesce("error", F.concat(F.lit("no answer of the form asked for: "), F.substring(F.coalesce("answer", F.lit("")), 1, 120))))
        asked.withColumns({"valid": valid, "error": said, "round": F.lit(number), "run": F.lit(uuid.uuid4().hex)}).write.mode("append").parquet(f"{folder}/rounds")
    return state(pairs, answers(spark, folder))


def last_valid(done: DataFrame) -> DataFrame:
    """(pair, p_support, p_refute, p_unknown, served_model) of each pair's last valid answer."""
    kept = F.struct("p_support", "p_refute", "p_unknown", "served_model")
    return done.filter("valid").groupBy(*PAIR).agg(F.max_by(kept, F.struct("round", "run")).alias("x")).select(*PAIR, "x.*")


def assembled(samples: DataFrame, done: DataFrame) -> DataFrame:
    """(query_id, doc_ids, labels, probabilities) as ingestion takes them, one row for each nested sample of one claim: matrices
    in the order of its documents. A pair without a valid answer is an error that names it, as its row is read."""
    grid = samples.select("sample_id", F.get("claims", F.lit(0))["claim_id"].alias("claim_id"), F.posexplode("contexts").alias("pos", "c")).select("sample_id", "claim_id", "pos", "c.doc_id")
    met = grid.join(last_valid(done), PAIR, "left")
    hole = F.raise_error(F.concat(F.lit("no valid answer for "), F.concat_ws("/", *PAIR))).cast("double")
    p = F.array(F.when(F.col("p_support").isNull(), hole).otherwise(F.col("p_support")), F.col("p_unknown"), F.col("p_refute"))
    # the first of equal ones, in the order of the array
    label = F.element_at(F.array(*map(F.lit, VERBAL_LABELS)), F.array_position(F.col("p"), F.array_max("p")).cast("int"))
    cell = F.struct("pos", "doc_id", F.col("p"), label.alias("label"))
    row = met.withColumn("p", p).groupBy("sample_id").agg(F.array_sort(F.collect_list(cell)).alias("x"))
    return row.select(F.col("sample_id").alias("query_id"), F.transform("x", lambda c: c["doc_id"]).alias("doc_ids"), F.array(F.transform("x", lambda c: c["label"])).alias("labels"), F.array(F.transform("x", lambda c: c["p"])).alias("probabilities"))


def usage(done: DataFrame) -> DataFrame:
    """(served_model, answers, valid, input_tokens, output_tokens) over all rounds."""
    return done.groupBy("served_model").agg(F.count("*").alias("answers"), F.sum(F.col("valid").cast("long")).alias("valid"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
