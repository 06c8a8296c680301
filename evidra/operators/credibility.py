"""Verdicts under many maps from a source's credibility to its reliability, in one scan and one aggregate.

Fusion needs products over documents. Documents of one credibility share a reliability, so a map's products are those of its
classes multiplied: the aggregate has a set of products for each class and value that occurs in any map (eight for three
values of one class, four of another and two that are fixed), not for each map, and evidence isn't copied. Weighted averages
are linear in the reliabilities, so they come from sums by class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.gating import directional_vote, verdict
from evidra.operators.fusion import CLAIM, GROUP, fuse_evaluators, fused, products
from evidra.operators.metrics import classification_report
from evidra.operators.resampling import auroc_resamples, compared, label_scores
from evidra.operators.tables import kept

VERDICTS = ["supported", "refuted"]
METHODS = ("ds", "weighted_average", "majority_vote")
#: A map from credibility (None: unrated) to reliability.
Setting = dict[str | None, float]
_COMBINED = {"_ps": "product", "_pr": "product", "_pt": "product", "_ls": "sum", "_lr": "sum", "_lt": "sum", "_maxs": "greatest", "_maxr": "greatest", "_mint": "least", "_k": "sum"}


def grid(fixed: Setting, low: list[float], unrated: list[float]) -> dict[str, Setting]:
    """Settings for each value of class low and of unrated documents."""
    return {f"low={a},unrated={b}": {**fixed, "low": a, None: b} for a in low for b in unrated}


def _is(name: str | None) -> Column:
    return F.col("credibility").isNull() if name is None else F.coalesce(F.col("credibility") == name, F.lit(False))


def _classes(settings: dict[str, Setting]) -> list[str | None]:
    classes = list(next(iter(settings.values())))
    if any(set(s) != set(classes) for s in settings.values()):
        raise ValueError("the settings have to have the same classes")
    return classes


def _checked(evidence: DataFrame, classes: list[str | None]) -> DataFrame:
    """evidence, where a credibility that no setting knows is an error as it is read."""
    known = reduce(lambda a, b: a | b, map(_is, classes))
    lost = F.raise_error(F.concat(F.lit("no reliability for credibility "), F.coalesce("credibility", F.lit("null")))).cast("string")
    return evidence.withColumn("credibility", F.when(known, F.col("credibility")).otherwise(lost))


def fuse_settings(evidence: DataFrame, settings: dict[str, Setting]) -> DataFrame:
    """fuse_documents() of evidence (with credibility) under each setting, as (setting, claim, evaluator, ...)."""
    classes = _classes(settings)
    parts = sorted({(classes.index(c), v) for s in settings.values() for c, v in s.items()})
    made = [x for i, v in parts for x in products(F.when(_is(classes[i]), v * F.col("p_support")), F.when(_is(classes[i]), v * F.col("p_refute")), f"_{parts.index((i, v))}")]
    by = _checked(evidence, classes).groupBy(*GROUP).agg(*made, F.count("*").alias("n_docs"), F.min("evaluator_reliability").alias("evaluator_reliability"))
    join = {"product": lambda xs: reduce(lambda a, b: a * b, xs), "sum": lambda xs: reduce(lambda a, b: a + b, xs), "greatest": lambda xs: F.greatest(*xs, xs[0]), "least": lambda xs: F.least(*xs, xs[0])}

    def one(name: str, s: Setting) -> Column:
        own = [parts.index((classes.index(c), v)) for c, v in s.items()]
        return F.struct(F.lit(name).alias("setting"), *(join[how]([F.col(f"{c}_{k}") for k in own]).alias(c) for c, how in _COMBINED.items()))

    each = by.withColumn("_x", F.explode(F.array(*(one(n, s) for n, s in settings.items())))).select(*GROUP, "n_docs", "evaluator_reliability", "_x.*")
    return fused(each, "k_doc", "document_total_conflict")


def verdicts(claims: DataFrame, evidence: DataFrame, settings: dict[str, Setting]) -> DataFrame:
    """(setting, method, claim, gold_state, margin, predicted, ds_undefined) of fusion, weighted average and documents' votes. Where
    fusion is undefined its margin is 0 and ds_undefined says so; a claim without evidence has margin 0."""
    classes = _classes(settings)
    own = fuse_evaluators(fuse_settings(evidence, settings), ["setting", *CLAIM]).select("setting", *CLAIM, (F.col("m_support") - F.col("m_refute")).alias("ds"), F.col("m_support").isNull().alias("undefined"))
    er, gap = F.col("evaluator_reliability"), F.col("p_support") - F.col("p_refute")
    sums = [f(F.when(_is(c), x)).alias(f"{n}{i}") for i, c in enumerate(classes) for f, n, x in ((F.sum, "a", er * gap), (F.sum, "w", er))]
    by = _checked(evidence, classes).groupBy(*CLAIM).agg(*sums, F.avg(directional_vote(F.col("p_support"), F.col("p_refute"), F.col("p_unknown"))).alias("votes"))
    total = lambda s, n: reduce(lambda a, b: a + b, (v * F.coalesce(F.col(f"{n}{classes.index(c)}"), F.lit(0.0)) for c, v in s.items()))
    average = F.explode(F.array(*(F.struct(F.lit(name).alias("setting"), F.try_divide(total(s, "a"), total(s, "w")).alias("average")) for name, s in settings.items())))
    plain = by.withColumn("_x", average).select(*CLAIM, "votes", "_x.*")
    rows = claims.withColumn("setting", F.explode(F.array(*map(F.lit, settings)))).join(own, ["setting", *CLAIM], "left").join(plain, ["setting", *CLAIM], "left")
    cells = F.array(*(F.struct(F.lit(m).alias("method"), F.coalesce(c, F.lit(0.0)).alias("margin"), (F.coalesce("undefined", F.lit(False)) if m == "ds" else F.lit(False)).alias("ds_undefined")) for m, c in zip(METHODS, ("ds", "average", "votes"), strict=True)))
    out = rows.withColumn("_c", F.explode(cells)).select("setting", *CLAIM, "gold_state", "_c.*")
    return out.withColumn("predicted", verdict(F.col("margin"), F.lit(0.0)))


def verdict_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, accuracy, macro_f1 over both verdicts, auroc of the margin, undetermined, ds_undefined, predicted_supported,
    n) of verdicts()."""
    # what is counted is a small table; the rows are read once for it and once for the order of their margins
    counts = kept(rows.groupBy(*keys, "gold_state", "predicted", "ds_undefined").agg(F.count("*").alias("_n")), "counts")
    labels = classification_report(counts, keys, VERDICTS, times="_n")
    ranks = auroc_resamples(rows.select(*keys, F.round("margin", 9).alias("score"), (F.col("gold_state") == VERDICTS[0]).cast("int").alias("positive")), 0, 0, keys, []).select(*keys, "auroc")
    count = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    rest = counts.groupBy(*keys).agg(count(~F.col("predicted").isin(VERDICTS)).alias("undetermined"), count(F.col("ds_undefined")).alias("ds_undefined"), count(F.col("predicted") == VERDICTS[0]).alias("predicted_supported"))
    return labels.join(ranks, keys).join(rest, keys)


def compare_verdicts(rows: DataFrame, pairs: list[tuple[tuple[str, str], tuple[str, str]]], resamples: int = 5000, seed: int = 42) -> DataFrame:
    """(a, b, metric, both values, delta, low, high, p_value, n_resamples) of pairs of (setting, method) of verdicts(): a less b
    in Macro-F1 over both verdicts and in the AUROC of the margin."""
    side = lambda s: (F.col("setting") == s[0]) & (F.col("method") == s[1])
    cells = F.filter(F.array(*(F.struct(F.lit("@".join(a[::-1])).alias("a"), F.lit("@".join(b[::-1])).alias("b"), F.when(side(x), n).alias("name")) for a, b in pairs for n, x in (("reference", a), ("rival", b)))), lambda c: c["name"].isNotNull())
    long = rows.withColumn("_p", F.explode(cells)).select("_p.a", "_p.b", "_p.name", *CLAIM, "gold_state", "predicted", F.round("margin", 9).alias("score"), (F.col("gold_state") == VERDICTS[0]).cast("int").alias("positive"))
    labels = label_scores(long, ["a", "b", "name"], ["predicted"], CLAIM, resamples, seed, VERDICTS).filter("metric = 'macro_f1'").select("a", "b", "name", "metric", "resample", "value")
    ranks = auroc_resamples(long, resamples, seed, ["a", "b", "name"], CLAIM).select("a", "b", "name", F.lit("auroc").alias("metric"), "resample", F.col("auroc").alias("value"))
    return compared(labels.unionByName(ranks), ["a", "b", "metric"], "reference").drop("reference", "rival")
