"""Integrity checks as one table of violations (kind, sample_id, detail), by grouped counts and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(claims: DataFrame, contexts: DataFrame, relations: DataFrame) -> DataFrame:
    """Duplicate claims, documents and relations; relations to unknown claims or documents; probabilities that don't
    sum to 1; claims with documents but no evaluator; an evaluator's missing documents; reliabilities that vary."""
    key = ["sample_id", "claim_id", "doc_id", "evaluator"]

    def row(df: DataFrame, kind: str, *detail: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col("sample_id").cast("string").alias("sample_id"), F.concat_ws("/", *(F.col(c).cast("string") for c in detail)).alias("detail"))

    def repeated(df: DataFrame, kind: str, *keys: str) -> DataFrame:
        return row(df.groupBy(*keys).count().filter("count > 1"), kind, *keys[1:])

    pairs = relations.select("sample_id", "claim_id", "evaluator").distinct()
    by_claim = relations.select("sample_id", "claim_id").distinct()
    expected = pairs.join(contexts.select("sample_id", "doc_id"), "sample_id")
    p = [F.col(c) for c in ("p_support", "p_refute", "p_unknown")]
    sane = reduce(lambda a, b: a & b, (x.between(0, 1) & ~F.isnan(x) for x in p)) & (F.abs(p[0] + p[1] + p[2] - 1) <= 1e-6)
    varied = relations.groupBy("sample_id", "claim_id", "evaluator").agg(F.min("evaluator_reliability").alias("low"), F.max("evaluator_reliability").alias("high")).filter("low <> high")
    parts = [
        repeated(claims, "duplicate_claim", "sample_id", "claim_id"), repeated(contexts, "duplicate_document", "sample_id", "doc_id"), repeated(relations, "duplicate_relation", *key),
        row(relations.join(claims.select("sample_id", "claim_id"), ["sample_id", "claim_id"], "left_anti"), "unknown_claim", *key[1:]),
        row(relations.join(contexts.select("sample_id", "doc_id"), ["sample_id", "doc_id"], "left_anti"), "unknown_document", *key[1:]),
        row(relations.filter(~F.coalesce(sane, F.lit(False))), "bad_probabilities", *key[1:]),
        row(claims.join(contexts.select("sample_id").distinct(), "sample_id", "left_semi").join(by_claim, ["sample_id", "claim_id"], "left_anti"), "no_evaluator", "claim_id"),
        row(expected.join(relations.select(*key), key, "left_anti"), "missing_relation", *key[1:]), row(varied, "varying_reliability", "claim_id", "evaluator"),
    ]
    return reduce(DataFrame.unionByName, parts)


def grid_violations(relations: DataFrame, samples: DataFrame, evaluator: str) -> DataFrame:
    """(kind, sample_id, detail) of relations that aren't one evaluator's complete grid over nested samples: missing, extra and
    repeated pairs, and other evaluators."""
    key = ["sample_id", "claim_id", "doc_id"]
    grid = samples.select("sample_id", F.explode("claims.claim_id").alias("claim_id"), "contexts").select("sample_id", "claim_id", F.explode("contexts.doc_id").alias("doc_id"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "sample_id", F.concat_ws("/", *key[1:]).alias("detail"))
    parts = [
        named(grid.join(relations, key, "left_anti"), "missing"), named(relations.join(grid, key, "left_anti"), "extra"),
        named(relations.groupBy(*key).count().filter("count > 1"), "repeated"), named(relations.filter(~F.col("evaluator").eqNullSafe(F.lit(evaluator))), "other_evaluator"),
    ]
    return reduce(DataFrame.unionByName, parts)


def empty_samples(samples: DataFrame) -> DataFrame:
    """(sample_id) of nested samples without a claim, or with a claim or document id that comes twice."""
    twice = lambda ids: F.size(F.array_distinct(ids)) < F.size(ids)
    return samples.filter((F.size("claims") <= 0) | twice(F.col("claims.claim_id")) | twice(F.col("contexts.doc_id"))).select("sample_id")


def first_documents(contexts: DataFrame, count: int) -> DataFrame:
    """The first count documents (by pos) of the samples that have as many."""
    from pyspark.sql import Window

    by = Window.partitionBy("sample_id")
    ranked = contexts.withColumns({"_n": F.row_number().over(by.orderBy("pos")), "_all": F.count("*").over(by)})
    return ranked.filter((F.col("_all") >= count) & (F.col("_n") <= count)).drop("_n", "_all")


def restricted(contexts: DataFrame, relations: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """first_documents() and the relations to them."""
    kept = first_documents(contexts, count)
    return kept, relations.join(kept.select("sample_id", "doc_id"), ["sample_id", "doc_id"], "left_semi")
