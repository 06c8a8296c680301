"""Classification and detection metrics as grouped and windowed aggregates.

Rows are first counted by score; sums over the order of scores are running() sums, so no task sees all scores of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.running import bucket, edges, once, running

LABELS = ["supported", "refuted", "insufficient", "conflicting", "undetermined"]


def confusion(predictions: DataFrame, keys: list[str], times: str | None = None) -> DataFrame:
    """(keys, gold, predicted, n) of rows (gold_state, predicted), each counted once or so many times."""
    n = F.count("*") if times is None else F.sum(times)
    return predictions.groupBy(*keys, F.col("gold_state").alias("gold"), "predicted").agg(n.alias("n"))


def class_metrics(predictions: DataFrame, keys: list[str], times: str | None = None) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and support of each label that is gold or predicted somewhere."""
    cells = confusion(predictions, keys, times)
    side = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("is_gold")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("is_gold"))))
    flat = cells.withColumn("_s", side).select(*keys, "_s.label", "_s.is_gold", "n", (F.col("gold") == F.col("predicted")).alias("hit"))
    out = flat.groupBy(*keys, "label").agg(
        F.coalesce(F.sum(F.when(F.col("is_gold") == 1, F.col("n"))), F.lit(0)).alias("support"), F.coalesce(F.sum(F.when(F.col("is_gold") == 0, F.col("n"))), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when((F.col("is_gold") == 1) & F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))})


def classification_report(predictions: DataFrame, keys: list[str], macro_labels: list[str] | None = None, times: str | None = None) -> DataFrame:
    """accuracy and macro_f1: over the labels that are gold somewhere, or over a fixed list (absent ones count 0)."""
    by = class_metrics(predictions, keys, times)
    inside = F.col("support") > 0 if macro_labels is None else F.col("label").isin(macro_labels)
    count = F.count(F.when(inside, 1)) if macro_labels is None else F.lit(len(macro_labels))
    return by.groupBy(*keys).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), (F.sum(F.when(inside, F.col("f1"))) / count).alias("macro_f1"), F.sum("support").alias("n"))


def detection_report(rows: DataFrame, keys: list[str], times: str | None = None, spread: DataFrame | None = None) -> DataFrame:
    """auroc (ties averaged), average_precision and the best F1 with its lowest threshold, of rows (keys, score,
    positive 0/1), each counted once or so many times; null for one class only. Buckets of large inputs follow the scores
    of spread, or of rows."""
    one = F.lit(1) if times is None else F.col(times)
    by = rows.groupBy(*keys, "score").agg(F.sum(F.col("positive") * one).alias("p"), F.sum(one).alias("n"))
    by, large = once(by, "scores") if times is None else (by.filter("n > 0"), None)
    cum = running(by, keys, bucket(F.col("score"), edges(by, "score", large=large) if spread is None else edges(spread, "score")), [F.desc("score")], {"tp": F.col("p"), "at": F.col("n")}, descending=True)
    whole = by.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    # a row for each key: without the hint all scores of a key would meet in one task
    cum = cum.join(F.broadcast(whole), keys)
    # a positive beats the negatives below it and half of those beside it
    beaten = F.col("p") * ((F.col("all_n") - F.col("all_p")) - (F.col("at") - F.col("tp")) + (F.col("n") - F.col("p")) / 2)
    f1 = 2 * F.col("tp") / (F.col("at") + F.col("all_p"))
    both = (F.max("all_p") > 0) & (F.max("all_p") < F.max("all_n"))
    out = cum.withColumns({"beaten": beaten, "f1": f1}).groupBy(*keys).agg(
        F.try_divide(F.sum("beaten"), F.max("all_p") * (F.max("all_n") - F.max("all_p"))).alias("auroc"),
        F.when(both, F.sum(F.try_divide(F.col("p") * F.col("tp"), F.col("all_p") * F.col("at")))).alias("average_precision"),
        F.max(F.struct(F.col("f1"), (-F.col("score")).alias("neg"))).alias("_best"), F.max("all_p").alias("positives"), F.max("all_n").alias("n"),
    )
    return out.withColumns({"best_f1": F.col("_best.f1"), "best_threshold": -F.col("_best.neg")}).drop("_best")


def auroc_outside(rows: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """(outer, keys, auroc): detection_report()'s auroc for each outer fold on the rows (keys, fold, score, positive 0/1) of the
    others, and no row where these have none. Scores are counted and sorted once: what lies outside a fold is all less the
    fold's own. fold is a number."""
    inside = [F.lit(True), *(F.col("fold") == f for f in range(folds))]
    sums = [F.sum(F.when(w, x).otherwise(0)).alias(f"{c}{i}") for i, w in enumerate(inside) for c, x in (("p", F.col("positive")), ("n", F.lit(1)))]
    by, large = once(rows.groupBy(*keys, "score").agg(*sums), "scores")
    cum = running(by, keys, bucket(F.col("score"), edges(by, "score", large=large)), [F.col("score")], {f"upto{i}": F.col(f"n{i}") - F.col(f"p{i}") for i in range(folds + 1)})
    less = lambda c, f: F.col(f"{c}0") - F.col(f"{c}{f + 1}")
    # a positive beats the negatives below it and half of those beside it
    beaten = [F.sum(less("p", f) * (less("upto", f) - (less("n", f) - less("p", f)) / 2)).alias(f"b{f}") for f in range(folds)]
    out = cum.groupBy(*keys).agg(*beaten, *(F.sum(less(c, f)).alias(f"{c}{f}") for f in range(folds) for c in "pn"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("outer"), F.col(f"b{f}").alias("b"), F.col(f"p{f}").alias("p"), F.col(f"n{f}").alias("n")) for f in range(folds))))
    return out.select(*keys, each.alias("x")).filter("x.n > 0").select("x.outer", *keys, F.try_divide(F.col("x.b"), F.col("x.p").cast("double") * (F.col("x.n") - F.col("x.p"))).alias("auroc"))


def coverages() -> list[float]:
    """0.50 to 1.00 by 0.02."""
    return [round(0.5 + 0.02 * i, 2) for i in range(26)]


def risk_coverage(rows: DataFrame, keys: list[str], times: str | None = None, spread: DataFrame | None = None) -> DataFrame:
    """(keys, coverage, risk): the error rate of the least risky share of rows (keys, risk_score, order_key, correct), each
    counted once or so many times; order_key is a number. Buckets of large inputs follow spread, or rows."""
    one, large = F.lit(1) if times is None else F.col(times), None
    if spread is None:
        rows, large = once(rows, "risks")
    values = rows if spread is None else spread
    place = bucket(F.col("risk_score"), at := edges(values, "risk_score", large=large), F.col("order_key"), edges(values, "order_key", large=large) if at else [])
    ranked = running(rows.withColumn("_w", one), keys, place, [F.col("risk_score"), F.col("order_key")], {"k": F.col("_w"), "hits": F.col("correct") * F.col("_w")})
    whole = rows.groupBy(*keys).agg(F.sum(one).alias("n"))
    wanted = F.transform(F.array(*map(F.lit, coverages())), lambda c: F.struct(c.alias("coverage"), F.greatest(F.lit(1), F.bround(F.col("n") * c)).cast("long").alias("want")))
    # the row at which a wanted place lies, of whose copies some count
    inside = F.filter(wanted, lambda x: (x["want"] > F.col("k") - F.col("_w")) & (x["want"] <= F.col("k")))
    at_row = ranked.join(F.broadcast(whole), keys).withColumn("_c", F.explode(inside)).select(*keys, "_c.*", "k", "hits", "correct")
    return at_row.select(*keys, "coverage", (1 - (F.col("hits") - (F.col("k") - F.col("want")) * F.col("correct")) / F.col("want")).alias("risk"))


def aurc(rows: DataFrame, keys: list[str], times: str | None = None, spread: DataFrame | None = None) -> DataFrame:
    """The mean risk over all coverages."""
    return risk_coverage(rows, keys, times, spread).groupBy(*keys).agg(F.avg("risk").alias("aurc"))
