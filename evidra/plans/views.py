"""Evidence tables derived from the order tables, the same in Spark and in SQL (see FIXTURES.md, part 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the view.
EVALUATORS = {"e1": 0.9, "e2": 0.7}
DOCUMENT_RELIABILITY = [1.0, 0.9, 0.6, 0.2]
STATES = ["supported", "refuted", "insufficient", "conflicting"]
THETA, K_DOC, K_EVAL, TIE = 0.2371, 0.3137, 0.4, 1e-6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, claim_id, gold_state): one claim for each order."""
    gold = F.element_at(F.array(*map(F.lit, STATES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderkey").alias("claim_id"), gold.alias("gold_state"))


def contexts(spark: SparkSession, sf_dir: str, names: int = 1) -> DataFrame:
    """(sample_id, doc_id, pos, reliability, a, b, c): one document for each order line number. Lines are dealt out by their
    order once, before anything is made of them: what is grouped by document, claim and evaluator, or claim, stays there.
    names says how many columns name the order in a join that follows, which then needs no other shuffle of them."""
    docs = (
        table(spark, sf_dir, "lineitem")
        .repartition(*["l_orderkey"] * names)
        .groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("doc_id"))
        .agg((F.max("l_quantity") / 50).alias("a"), (F.max("l_discount") * 10).alias("b"), (F.max("l_tax") * 12.5).alias("c"), F.min("l_suppkey").alias("source_id"))
    )
    reliability = F.element_at(F.array(*map(F.lit, DOCUMENT_RELIABILITY)), (F.col("source_id") % 4 + 1).cast("int"))
    return docs.withColumn("pos", F.col("doc_id")).withColumn("reliability", reliability)


def evidence(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """Relations with their documents' reliability: two evaluators for each document. No join: both come from one row. Lines
    are dealt out by sample and claim, both the order here: what is fused meets its claims where it is."""
    total = F.col("a") + F.col("b") + F.col("c") + 0.15
    p = {k: (F.col(k) + 0.05) / total for k in "abc"}
    rows = [
        F.struct(F.lit(name).alias("evaluator"), F.lit(EVALUATORS[name]).alias("evaluator_reliability"), *(p[k].alias(c) for k, c in zip(order, ("p_support", "p_refute", "p_unknown"), strict=True)))
        for name, order in (("e1", "abc"), ("e2", "bca"))
    ]
    docs = contexts(spark, sf_dir, names=2).withColumn("r", F.explode(F.array(*rows)))
    return docs.select("sample_id", F.col("sample_id").alias("claim_id"), "doc_id", "pos", F.col("reliability").alias("doc_reliability"), "r.*", *(keep or []))


def supplier_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As evidence(), by the first evaluator alone, with one claim for each supplier: hundreds of documents a claim."""
    docs = evidence(spark, sf_dir, keep=["source_id"]).filter("evaluator = 'e1'")
    return docs.withColumns({"claim_id": F.col("source_id"), "pos": F.col("sample_id") * 10 + F.col("pos"), "sample_id": F.col("source_id")})


def rated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evidence() with the credibility of its source; every fourth source is unrated."""
    rated = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit(None).cast("string")), (F.col("source_id") % 4 + 1).cast("int"))
    return evidence(spark, sf_dir, keep=["source_id"]).withColumn("credibility", rated).drop("source_id")


def voted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of votes on each document: up to four for each side, by its own measures; without a vote all are equal."""
    votes = {k: F.floor(4 * F.col(c) + 1e-9) for k, c in (("support", "a"), ("refute", "b"), ("unknown", "c"))}
    total = sum(votes.values())
    share = lambda v: F.when(total > 0, v / total).otherwise(1 / 3)
    return contexts(spark, sf_dir).select("sample_id", F.col("sample_id").alias("claim_id"), "doc_id", *(share(v).alias(f"p_{k}") for k, v in votes.items()))


def torn_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evidence() with certain relations put in, so that every status occurs: of ten claims one has documents in total
    conflict, one evaluators, one the former in an evaluator of reliability 0, and one no evaluator of any reliability."""
    kind, first, e1 = F.col("claim_id") % 10, F.col("doc_id") == 1, F.col("evaluator") == "e1"
    sure = F.when(kind.isin(1, 3), F.when(first, 1).otherwise(-1)).when(kind == 2, F.when(e1, 1).otherwise(-1))
    sure = F.when((kind == 2) | (kind.isin(1, 3) & e1), sure)
    reliability = F.when(kind == 2, 1.0).when(((kind == 3) & e1) | (kind == 4), 0.0).otherwise(F.col("evaluator_reliability"))
    pick = lambda c, side: F.when(sure.isNull(), F.col(c)).otherwise((sure == side).cast("double"))
    return evidence(spark, sf_dir).withColumns({
        "p_support": pick("p_support", 1), "p_refute": pick("p_refute", -1), "p_unknown": pick("p_unknown", 0),
        "doc_reliability": F.when(sure.isNull(), F.col("doc_reliability")).otherwise(1.0), "evaluator_reliability": reliability,
    })


#: The same tables for SQL; decimals are cast so that all arithmetic is in double precision.
SQL = """
WITH claims AS (
    SELECT o_orderkey AS sample_id, o_orderkey AS claim_id, ['supported', 'refuted', 'insufficient', 'conflicting'][(o_orderkey % 4 + 1)::INT] AS gold_state FROM orders
), contexts AS (
    SELECT l_orderkey AS sample_id, l_linenumber AS doc_id, l_linenumber AS pos, max(l_quantity) / 50 AS a, max(l_discount) * 10 AS b, max(l_tax) * 12.5::DOUBLE AS c,
           [1.0::DOUBLE, 0.9, 0.6, 0.2][(min(l_suppkey) % 4 + 1)::INT] AS reliability, min(l_suppkey) AS source_id
    FROM lineitem GROUP BY l_orderkey, l_linenumber
), evidence AS (
    SELECT sample_id, sample_id AS claim_id, doc_id, pos, reliability AS doc_reliability, 'e1' AS evaluator, 0.9::DOUBLE AS evaluator_reliability,
           (a + 0.05::DOUBLE) / (a + b + c + 0.15::DOUBLE) AS p_support, (b + 0.05::DOUBLE) / (a + b + c + 0.15::DOUBLE) AS p_refute, (c + 0.05::DOUBLE) / (a + b + c + 0.15::DOUBLE) AS p_unknown FROM contexts
    UNION ALL
    SELECT sample_id, sample_id, doc_id, pos, reliability, 'e2', 0.7::DOUBLE,
           (b + 0.05::DOUBLE) / (a + b + c + 0.15::DOUBLE), (c + 0.05::DOUBLE) / (a + b + c + 0.15::DOUBLE), (a + 0.05::DOUBLE) / (a + b + c + 0.15::DOUBLE) FROM contexts
)"""
