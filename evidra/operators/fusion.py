"""Dempster-Shafer fusion as grouped sums of logarithms.

With mass on support, refute and the whole frame only, combining masses one after another equals three products over
the group: of 1 - r, of 1 - s and of theta. Fusion is thus a plain aggregate that is combined before the shuffle: no
ordered collection, no UDF. Masses are ratios of the products. Where these get too small for a double, the same ratios come
from sums of logarithms, so any number of documents is exact; the accumulated conflict is one minus the normaliser. Evidence rows have the columns
(sample_id, claim_id, doc_id, pos, evaluator, evaluator_reliability, doc_reliability, p_support, p_refute, p_unknown).

A combination step is a total conflict if its normaliser is at most TOTAL. That takes a document within TOTAL of
certainty on either side, so it is decided by the surest documents of both sides, whatever their order. (Folding in
order can also stop where one certain document comes after many opposed ones whose sum is certain but for rounding; here
the certain document prevails in any order, as it does in the fold where it comes first. trace() folds in order.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.gating import Thresholds, discounted, gated_state, region, unit, verdict

#: A combination step with a normaliser of at most this is a total conflict.
TOTAL = 1e-12
CLAIM = ["sample_id", "claim_id"]
GROUP = [*CLAIM, "evaluator"]


def join_evidence(relations: DataFrame, contexts: DataFrame) -> DataFrame:
    """Relations with the place and reliability of their documents (sample_id, doc_id, pos, reliability). A relation to an
    unknown document is an error as its row is read."""
    docs = contexts.select("sample_id", "doc_id", "pos", F.col("reliability").alias("doc_reliability"), F.lit(1).alias("_known"))
    lost = F.raise_error(F.concat(F.lit("unknown document: "), F.concat_ws("/", F.col("sample_id").cast("string"), F.col("doc_id").cast("string")))).cast("double")
    df = relations.join(docs, ["sample_id", "doc_id"], "left")
    return df.withColumn("doc_reliability", F.when(F.col("_known").isNull(), lost).otherwise(F.col("doc_reliability"))).drop("_known")


def nested_evidence(relations: DataFrame, samples: DataFrame) -> DataFrame:
    """As join_evidence() with the documents nested in samples (sample_id, contexts). Rows meet by their sample alone, so what is
    grouped by claim and evaluator, or claim, stays where they met."""
    ids = F.transform("contexts", lambda c: c["doc_id"])
    docs = samples.select("sample_id", F.transform("contexts", lambda c, i: F.struct(c["doc_id"].alias("doc_id"), i.alias("pos"), c["reliability"].alias("doc_reliability"))).alias("_docs"), ids.alias("_ids"), (F.size(F.array_distinct(ids)) < F.size(ids)).alias("_twice"))
    lost = F.raise_error(F.concat(F.lit("unknown document: "), F.concat_ws("/", F.col("sample_id").cast("string"), F.col("doc_id").cast("string")))).cast(docs.schema["_docs"].dataType)
    # a document's place is looked up; only where a sample has one twice all documents are looked through
    at = F.coalesce(F.array_position("_ids", F.col("doc_id")), F.lit(0))
    found = F.when(F.col("_twice"), F.filter("_docs", lambda c: c["doc_id"] == F.col("doc_id"))).otherwise(F.array(F.get("_docs", (F.col("_at") - 1).cast("int"))))
    df = relations.join(docs.hint("shuffle_hash"), "sample_id", "left").withColumn("_at", at).withColumn("_d", F.explode(F.when(F.col("_at") > 0, found).otherwise(lost)))
    return df.select(*relations.columns, "_d.pos", "_d.doc_reliability")


def masses(evidence: DataFrame, reliability: Column | None = None) -> DataFrame:
    """Evidence with the discounted masses m_support, m_refute and m_theta of each document."""
    s, r, t = discounted(F.col("p_support"), F.col("p_refute"), F.col("doc_reliability") if reliability is None else reliability)
    return evidence.withColumns({"m_support": s, "m_refute": r, "m_theta": t})


def identified(evidence: DataFrame) -> DataFrame:
    """Evidence with its probabilities as masses that nothing is taken off yet (reliability_applied: 1)."""
    return evidence.withColumns({"m_support": F.col("p_support"), "m_refute": F.col("p_refute"), "m_theta": unit(1 - F.col("p_support") - F.col("p_refute")), "reliability_applied": F.lit(1.0)})


def discount(rows: DataFrame, reliability: Column) -> DataFrame:
    """Masses discounted once more. reliability_applied is the product of all discounts: several in turn are one by it."""
    s, r, t = discounted(F.col("m_support"), F.col("m_refute"), reliability)
    return rows.withColumns({"m_support": unit(s), "m_refute": unit(r), "m_theta": unit(t), "reliability_applied": unit(F.col("reliability_applied") * reliability)})


#: Products below are left for sums of logarithms.
LEAST_PRODUCT = 1e-200


def products(s: Column, r: Column, tag: str = "") -> list[Column]:
    """Products and sums from which fused() takes the masses of a group; null masses are left out. tag ends their names."""
    t = F.when(s.isNotNull(), F.greatest(F.lit(0.0), 1 - s - r))
    total = lambda x, inside: F.coalesce(F.sum(F.when(inside, x)), F.lit(0.0))
    product = lambda x: F.coalesce(F.product(x), F.lit(1.0))
    return [
        product(1 - r).alias(f"_ps{tag}"), product(1 - s).alias(f"_pr{tag}"), product(t).alias(f"_pt{tag}"),
        total(F.log1p(-r), r < 1).alias(f"_ls{tag}"), total(F.log1p(-s), s < 1).alias(f"_lr{tag}"), total(F.log(t), t > 0).alias(f"_lt{tag}"),
        F.coalesce(F.max(s), F.lit(0.0)).alias(f"_maxs{tag}"), F.coalesce(F.max(r), F.lit(0.0)).alias(f"_maxr{tag}"), F.coalesce(F.min(t), F.lit(1.0)).alias(f"_mint{tag}"), F.count(s).alias(f"_k{tag}"),
    ]


def fused(df: DataFrame, conflict: str, total: str) -> DataFrame:
    """Masses, the accumulated conflict and the flag of a total conflict, from the columns of products()."""
    c = F.col
    no_s, no_r, no_t = c("_maxr") >= 1, c("_maxs") >= 1, c("_mint") <= 0  # products that are exactly 0
    least = F.lit(float("-inf"))
    small = (~no_s & (c("_ps") < LEAST_PRODUCT)) | (~no_r & (c("_pr") < LEAST_PRODUCT))
    df = df.withColumn("_top", F.when(small, F.greatest(F.when(no_s, least).otherwise(c("_ls")), F.when(no_r, least).otherwise(c("_lr")))).otherwise(0.0))
    share = lambda zero, x, product: F.when(~small, c(product)).when(zero, 0.0).otherwise(F.exp(c(x) - c("_top")))
    df = df.withColumns({"_qs": share(no_s, "_ls", "_ps"), "_qr": share(no_r, "_lr", "_pr"), "_qt": share(no_t, "_lt", "_pt")})
    df = df.withColumn("_n", c("_qs") + c("_qr") - c("_qt"))
    # of two masses the normaliser is that of their only step; of more, that of the two surest opposed ones
    doubt = F.when(c("_k") == 2, F.exp(c("_top")) * c("_n")).otherwise((1 - c("_maxs")) + (1 - c("_maxr")))
    df = df.withColumn(total, (no_s & no_r) | ((c("_k") > 1) & (doubt <= TOTAL)))
    at = lambda x: F.when(~c(total), unit(x / c("_n")))
    out = df.withColumns({
        "m_support": at(c("_qs") - c("_qt")), "m_refute": at(c("_qr") - c("_qt")), "m_theta": at(c("_qt")),
        conflict: F.when(c(total), 1.0).otherwise(unit(1 - F.exp(c("_top")) * c("_n"))),
    })
    return out.drop("_ps", "_pr", "_pt", "_ls", "_lr", "_lt", "_maxs", "_maxr", "_mint", "_k", "_top", "_qs", "_qr", "_qt", "_n")


def fuse_documents(evidence: DataFrame, keys: list[str] = GROUP, reliability: Column | None = None, also: list[Column] = []) -> DataFrame:  # noqa: B006
    """One row for each key: fused masses, k_doc, n_docs, and whether the documents contradict each other totally (their
    masses are null then), and what also aggregates."""
    s, r, _ = discounted(F.col("p_support"), F.col("p_refute"), F.col("doc_reliability") if reliability is None else reliability)
    grouped = evidence.groupBy(*keys).agg(*products(s, r), F.count("*").alias("n_docs"), F.min("evaluator_reliability").alias("evaluator_reliability"), *also)
    return fused(grouped, "k_doc", "document_total_conflict")


def trace(evidence: DataFrame) -> DataFrame:
    """The ordered fold of each (claim, evaluator): steps with the conflict and normaliser of each combination, up to a
    total conflict. For diagnosis; it holds the documents of a claim in one row."""
    one = F.struct("pos", "doc_id", F.col("m_support").alias("s"), F.col("m_refute").alias("r"), F.col("m_theta").alias("t"))
    ordered = masses(evidence).groupBy(*GROUP).agg(F.array_sort(F.collect_list(one)).alias("_docs"))
    step = "struct<index:int,conflict:double,denominator:double>"
    first = F.struct(*(F.get("_docs", F.lit(0))[k].alias(k) for k in "srt"), F.lit(False).alias("stopped"), F.array().cast(f"array<{step}>").alias("steps"))

    def combine(a: Column, b: Column) -> Column:
        k = a["s"] * b["r"] + a["r"] * b["s"]
        d = 1 - k
        stop = a["stopped"] | (d <= TOTAL)
        keep = lambda x, old: F.when(stop, old).otherwise(x / d)
        steps = F.when(a["stopped"], a["steps"]).otherwise(F.concat(a["steps"], F.array(F.struct((F.size(a["steps"]) + 1).alias("index"), k.alias("conflict"), d.alias("denominator")).cast(step))))
        return F.struct(
            keep(a["s"] * b["s"] + a["s"] * b["t"] + a["t"] * b["s"], a["s"]).alias("s"), keep(a["r"] * b["r"] + a["r"] * b["t"] + a["t"] * b["r"], a["r"]).alias("r"),
            keep(a["t"] * b["t"], a["t"]).alias("t"), stop.alias("stopped"), steps.alias("steps"),
        )

    rest = F.slice("_docs", F.lit(2), F.greatest(F.size("_docs") - 1, F.lit(0)))
    return ordered.withColumn("_f", F.aggregate(rest, first, combine)).select(
        *GROUP, F.col("_f.steps").alias("steps"), F.col("_f.stopped").alias("document_total_conflict"),
        *(F.when(~F.col("_f.stopped"), F.col(f"_f.{k}")).alias(n) for k, n in (("s", "m_support"), ("r", "m_refute"), ("t", "m_theta"))),
        (F.abs(F.col("_f.s") + F.col("_f.r") + F.col("_f.t") - 1) > 1e-6).alias("mass_unstable"),
    )


def fuse_evaluators(documents: DataFrame, keys: list[str] = CLAIM, also: list[Column] | None = None) -> DataFrame:
    """One row for each claim from fuse_documents(): each evaluator's mass is discounted by its reliability and fused.

    An evaluator of positive reliability in total document conflict decides the claim (document_total_conflict);
    evaluators of reliability 0 without a mass are left out. k_doc is weighted by reliability. also: aggregates instead of the
    evaluators' names."""
    er = F.col("evaluator_reliability")
    s, r, _ = discounted(F.col("m_support"), F.col("m_refute"), er)
    kept = ~F.col("document_total_conflict")
    claim = documents.groupBy(*keys).agg(
        *products(s, r), F.max((~kept & (er > 0)).cast("int")).alias("_total"), F.count(F.when(kept, 1)).alias("n_evaluators"),
        F.sum(F.when(kept, er * F.col("k_doc"))).alias("_rk"), F.sum(F.when(kept, er)).alias("_r"), *([F.array_sort(F.collect_set("evaluator")).alias("evaluators")] if also is None else also),
    )
    out = fused(claim, "k_eval", "evaluator_total_conflict")
    out = out.withColumns({m: F.when(F.col("n_evaluators") > 0, F.col(m)) for m in ("m_support", "m_refute", "m_theta")})
    return out.withColumns({
        "k_doc": F.coalesce(F.try_divide(F.col("_rk"), F.col("_r")), F.lit(0.0)), "document_total_conflict": F.col("_total") == 1,
        "k_eval": F.when(F.col("n_evaluators") > 1, F.col("k_eval")).otherwise(0.0),
    }).drop("_rk", "_r", "_total")


def diagnose(claims: DataFrame, fused: DataFrame, t: Thresholds, keys: list[str] = CLAIM) -> DataFrame:
    """The diagnosis of every claim: status, masses, conflicts, region, verdict, state and flags.

    Claims without documents, or with no evaluator left, are vacuous and insufficient."""
    return diagnosed(claims.join(fused, keys, "left"), t)


def diagnosed(df: DataFrame, t: Thresholds) -> DataFrame:
    """diagnose() of claims beside their fused masses; n_evaluators is null for a claim without documents."""
    none = F.col("n_evaluators").isNull() | ((F.col("n_evaluators") == 0) & ~F.col("document_total_conflict"))
    doc = ~none & F.col("document_total_conflict")
    rows = ~none & ~doc & F.col("evaluator_total_conflict")
    pick = lambda vacuous, x: F.when(none, vacuous).when(~doc & ~rows, x)
    df = df.withColumns({
        "status": F.when(F.col("n_evaluators").isNull(), "no_contexts").when(doc, "document_total_conflict").when(rows, "evaluator_total_conflict").otherwise("normal"),
        "m_support": pick(0.0, F.col("m_support")), "m_refute": pick(0.0, F.col("m_refute")), "m_theta": pick(1.0, F.col("m_theta")),
        "k_doc": F.when(none, 0.0).when(doc, 1.0).otherwise(F.col("k_doc")), "k_eval": F.when(none | doc, 0.0).when(rows, 1.0).otherwise(F.col("k_eval")),
    })
    thin, torn = F.coalesce(F.col("m_theta") >= t.theta, F.lit(False)), F.col("k_doc") >= t.document_conflict
    df = df.withColumns({"evidence_insufficient": thin, "document_conflict": torn, "evaluator_disagreement": F.col("k_eval") >= t.evaluator_conflict, "verdict": F.coalesce(verdict(F.col("m_support"), F.col("m_refute"), t.tie), F.lit("undetermined"))})
    normal = ~F.col("status").isin("document_total_conflict", "evaluator_total_conflict")
    df = df.withColumns({
        "region": F.when(normal, region(F.col("evidence_insufficient"), F.col("document_conflict"))).otherwise(F.col("status")),
        "primary_state": F.when(F.col("status") == "document_total_conflict", "conflicting").when(normal, gated_state(F.col("evidence_insufficient"), F.col("document_conflict"), F.col("verdict"))),
    })
    return df.drop("evaluator_total_conflict", "document_total_conflict")


def run_pipeline(claims: DataFrame, evidence: DataFrame, t: Thresholds) -> DataFrame:
    """Claims (sample_id, claim_id, ...) with their diagnosis. One shuffle by claim and evaluator, one by claim."""
    return diagnose(claims, fuse_evaluators(fuse_documents(evidence)), t)


def summarise(results: DataFrame) -> DataFrame:
    """Counts of statuses, regions and states as (dimension, value, n)."""
    pair = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("none")).alias("value")) for d in ("status", "region", "primary_state"))))
    return results.select(pair.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
