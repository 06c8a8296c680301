"""Extension points: claim extraction and relation evaluation as functions over DataFrames.

An extractor maps samples to (sample_id, claim_id, claim_text); an evaluator maps pairs (sample_id, claim_id, doc_id,
claim_text, doc_text) to relations. Models run as batch functions under mapInArrow; look-ups are joins, and a missing
look-up is an error, never a default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(samples: DataFrame) -> DataFrame:
    """Every claim with every document of its sample."""
    both = samples.select("sample_id", F.explode("claims").alias("c"), "contexts").select("sample_id", "c", F.explode("contexts").alias("d"))
    return both.select("sample_id", "c.claim_id", "d.doc_id", F.col("c.text").alias("claim_text"), F.col("d.text").alias("doc_text"))


def evaluate(todo: DataFrame, model: Callable, evaluator: str, reliability: float = 1.0) -> DataFrame:
    """Relations by a model: a function over Arrow batches of pairs that adds p_support, p_refute and p_unknown."""
    out = todo.mapInArrow(model, "sample_id string, claim_id string, doc_id string, p_support double, p_refute double, p_unknown double")
    return out.withColumns({"evaluator": F.lit(evaluator), "evaluator_reliability": F.lit(reliability)})


def pending(todo: DataFrame, done: DataFrame, model: str | None = None, prompt_digest: str | None = None) -> DataFrame:
    """The pairs that a former run has no result for. Results of another model or prompt (columns model, prompt_digest) are
    an error."""
    for column, wanted in (("model", model), ("prompt_digest", prompt_digest)):
        if wanted is not None and done.filter(~F.col(column).eqNullSafe(F.lit(wanted))).limit(1).count():
            raise ValueError(f"the results so far are of another {column}")
    return todo.join(done.select("sample_id", "claim_id", "doc_id"), ["sample_id", "claim_id", "doc_id"], "left_anti")


def prompt_digest(*parts: str) -> str:
    """The SHA-256 of a prompt's parts."""
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def looked_up(todo: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations from a table; a pair that the table lacks is an error as its row is read, and one that it has twice at
    once."""
    key = ["sample_id", "claim_id", "doc_id"]
    if relations.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise ValueError("a pair comes twice")
    df = todo.select(*key).join(relations, key, "left")
    missing = F.raise_error(F.concat(F.lit("no relation for "), F.concat_ws("/", *key)))
    return df.withColumn("p_support", F.when(F.col("p_support").isNull(), missing).otherwise(F.col("p_support")))


def claims_from_texts(df: DataFrame, texts: str = "texts") -> DataFrame:
    """(sample_id, claim_id, claim_text) from an array of texts; blank ones are skipped and ids stay dense from 1."""
    kept = F.filter(F.transform(texts, F.trim), lambda t: t != "")
    return df.select("sample_id", F.posexplode(kept).alias("pos", "claim_text")).select("sample_id", F.concat(F.lit("c"), F.col("pos") + 1).alias("claim_id"), "claim_text")


def parsed_probabilities(df: DataFrame, text: str) -> DataFrame:
    """p_support, p_refute and p_unknown from a JSON answer, renormalised; null if a key is missing, out of range, or all
    are 0."""
    r = F.from_json(text, "support double, refute double, unknown double")
    total = r["support"] + r["refute"] + r["unknown"]
    ok = r["support"].between(0, 1) & r["refute"].between(0, 1) & r["unknown"].between(0, 1) & (total > 0)
    return df.withColumns({f"p_{k}": F.when(ok, r[k] / total) for k in ("support", "refute", "unknown")})
