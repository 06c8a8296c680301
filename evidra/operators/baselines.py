"""Decisions without fusion, on the same evidence: averages, votes and statistical gates. Each is one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.gating import BaselineThresholds, Thresholds, baseline_confidence, baseline_decision, conflict_rule, gated_state, verdict, vote
from evidra.operators.fusion import CLAIM

SCORES = ["score_support", "score_refute", "score_unknown"]
VARIANTS = [f"{c}{s}" for c in ("sr_std", "max_product", "doc_count") for s in ("", "_uprod")]


def weighted_by(weight: Column) -> list[Column]:
    """Averages of the three probabilities as aggregates; null if all weights are 0."""
    total = F.sum(weight)
    return [F.when(total > 0, F.sum(weight * F.col(p)) / total).alias(s) for p, s in zip(("p_support", "p_refute", "p_unknown"), SCORES, strict=True)]


def _voted() -> list[Column]:
    v = vote(F.col("p_support"), F.col("p_refute"), F.col("p_unknown"))
    return [F.avg((v == k).cast("double")).alias(s) for k, s in zip(("supported", "refuted", "unknown"), SCORES, strict=True)]


def weighted_scores(evidence: DataFrame, keys: list[str] = CLAIM) -> DataFrame:
    """Averages of the probabilities weighted by both reliabilities; null if all weights are 0."""
    return evidence.groupBy(*keys).agg(*weighted_by(F.col("doc_reliability") * F.col("evaluator_reliability")), F.count("*").alias("input_count"))


def vote_scores(evidence: DataFrame, keys: list[str] = CLAIM) -> DataFrame:
    """Shares of the votes, one for each relation, unweighted."""
    return evidence.groupBy(*keys).agg(*_voted(), F.count("*").alias("input_count"))


def single_scores(evidence: DataFrame, evaluator: str, keys: list[str] = CLAIM) -> DataFrame:
    """One evaluator's averages, weighted by document reliability. lacking is its name where others have judged a claim, but
    not this one: decide() makes that an error."""
    own = F.col("evaluator") == evaluator
    out = evidence.groupBy(*keys).agg(*weighted_by(F.when(own, F.col("doc_reliability"))), F.count(F.when(own, 1)).alias("input_count"))
    return out.withColumn("lacking", F.when(F.col("input_count") == 0, evaluator))


def decide(claims: DataFrame, scores: DataFrame, method: str, t: BaselineThresholds, keys: list[str] = CLAIM) -> DataFrame:
    """A row for each claim; without evidence the scores are (0, 0, 1). A claim that single_scores() finds the evaluator lacking
    for is an error as its row is read."""
    return _decided(claims.join(scores, keys, "left").withColumn("method", F.lit(method)), t, keys, "lacking" in scores.columns)


def _decided(df: DataFrame, t: BaselineThresholds, keys: list[str], lacking: bool) -> DataFrame:
    """df (claims, method, scores, input_count and, if there are such, lacking) with states."""
    if lacking:
        lost = F.raise_error(F.concat(F.lit("evaluator "), "lacking", F.lit(" has no relation for "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))).cast("double")
        df = df.withColumns({c: F.when(F.col("lacking").isNull(), F.col(c)).otherwise(lost) for c in SCORES}).drop("lacking")
    s, r, u = map(F.col, SCORES)
    state, reason = baseline_decision(s, r, u, t)
    torn = (F.col("method") == "conflict_aware") & F.coalesce(conflict_rule(s, r, t.conflict, t.margin), F.lit(False))
    state, reason = F.when(torn, "conflicting").otherwise(state), F.when(torn, "conflict_detected").otherwise(reason)
    df = df.withColumns({"state": state, "reason": reason, "input_count": F.coalesce("input_count", F.lit(0))})
    df = df.withColumns({c: F.coalesce(c, F.lit(float(c == "score_unknown"))) for c in SCORES})
    return df.withColumn("confidence", baseline_confidence(F.col("state"), *map(F.col, SCORES)))


def run_baselines(claims: DataFrame, evidence: DataFrame, t: BaselineThresholds, evaluator: str, keys: list[str] = CLAIM) -> DataFrame:
    """Four rows a claim: weighted_average, majority_vote, single_evaluator and conflict_aware. The evidence is read, and meets
    the claims, once; then a claim is dealt out to its methods."""
    own, made = F.col("evaluator") == evaluator, {"_w": weighted_by(F.col("doc_reliability") * F.col("evaluator_reliability")), "_v": _voted(), "_s": weighted_by(F.when(F.col("evaluator") == evaluator, F.col("doc_reliability")))}
    named = [c.alias(f"{tag}{i}") for tag, columns in made.items() for i, c in enumerate(columns)]
    by = evidence.groupBy(*keys).agg(*named, F.count("*").alias("_n"), F.count(F.when(own, 1)).alias("_own"))
    lacking = F.when(F.col("_own") == 0, evaluator)
    none, methods = F.lit(None).cast("string"), (("weighted_average", "_w", "_n", None), ("majority_vote", "_v", "_n", None), ("single_evaluator", "_s", "_own", lacking), ("conflict_aware", "_w", "_n", None))
    cells = [F.struct(F.lit(m).alias("method"), *(F.col(f"{tag}{i}").alias(c) for i, c in enumerate(SCORES)), F.col(n).alias("input_count"), (none if lost is None else lost).alias("lacking")) for m, tag, n, lost in methods]
    each = claims.join(by, keys, "left").withColumn("_x", F.explode(F.array(*cells))).select(*claims.columns, "_x.*")
    columns = [*keys, *(c for c in claims.columns if c not in keys), *SCORES, "input_count", "method", "state", "reason", "confidence"]
    return _decided(each, t, keys, True).select(*columns)


def stat_gate_scores(claims: DataFrame, evidence: DataFrame, keys: list[str] = CLAIM) -> DataFrame:
    """The scores of all six gate variants from one shuffle: weighted means, conflict_* and insufficiency_*.

    The deviation of support minus refute takes two passes: a window puts the claim's mean beside each row, and the aggregate
    after it, on the same partitioning, sums squares around it. It is 0 where all margins are equal."""
    w = F.col("doc_reliability") * F.col("evaluator_reliability")
    margin, claim = F.col("p_support") - F.col("p_refute"), Window.partitionBy(*keys)
    centred = evidence.withColumn("_mean", F.try_divide(F.sum(w * margin).over(claim), F.sum(w).over(claim)))
    # equal margins have a mean that rounding may take off them
    centred = centred.withColumn("_mean", F.when(F.max(margin).over(claim) == F.min(margin).over(claim), margin).otherwise(F.col("_mean")))
    total = F.sum(w)
    scores = centred.groupBy(*keys).agg(
        *weighted_by(w), F.when(total > 0, F.sqrt(F.sum(w * F.pow(margin - F.col("_mean"), F.lit(2.0))) / total)).alias("conflict_sr_std"), (F.max(w * F.col("p_support")) * F.max(w * F.col("p_refute"))).alias("conflict_max_product"),
        (1 - 1 / F.countDistinct("doc_id")).alias("conflict_doc_count"), F.product(1 - w * (1 - F.col("p_unknown"))).alias("insufficiency_uprod"),
        F.min(1 - w * (1 - F.col("p_unknown"))).alias("min_unknown"), F.least(F.max(w * F.col("p_support")), F.max(w * F.col("p_refute"))).alias("min_max"), F.countDistinct("doc_id").alias("document_count"),
    )
    df = claims.join(scores, keys, "left")
    none = F.col("score_support").isNull()
    zero = ["score_support", "score_refute", "conflict_sr_std", "conflict_max_product", "conflict_doc_count", "min_max"]
    df = df.withColumns({c: F.when(none, 0.0).otherwise(F.col(c)) for c in zero} | {c: F.when(none, 1.0).otherwise(F.col(c)) for c in ("score_unknown", "insufficiency_uprod", "min_unknown")})
    return df.withColumn("insufficiency_mean", F.col("score_unknown")).withColumn("document_count", F.coalesce("document_count", F.lit(0)))


def stat_gate_decisions(scores: DataFrame, t: Thresholds) -> DataFrame:
    """A row for each claim and variant, gated as the fused masses are."""
    pick = []
    for v in VARIANTS:
        conflict, insufficiency = F.col(f"conflict_{v.removesuffix('_uprod')}"), F.col("insufficiency_uprod" if v.endswith("_uprod") else "insufficiency_mean")
        pick.append(F.struct(F.lit(f"stat_gate_{v}").alias("method"), conflict.alias("conflict"), insufficiency.alias("insufficiency")))
    df = scores.withColumn("_v", F.explode(F.array(*pick))).select(*scores.columns, "_v.*")
    state = gated_state(F.col("insufficiency") >= t.theta, F.col("conflict") >= t.document_conflict, verdict(F.col("score_support"), F.col("score_refute"), t.tie))
    return df.withColumn("state", state)
