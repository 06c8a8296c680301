"""Threshold search: a small broadcast grid against claims that were fused once, and exact tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.gating import BaselineThresholds, baseline_decision, conflict_rule, gated_state, metric_label, verdict
from evidra.operators.cuts import quantiles, reached
from evidra.operators.metrics import classification_report
from evidra.operators.running import bucket, edges, once, running
from evidra.operators.tables import kept

# The thresholds that a search tries.
DECISIONS = [round(0.2 + 0.05 * i, 2) for i in range(15)]
CONFLICTS = [0.001, 0.005, *(round(0.01 + 0.01 * i, 2) for i in range(4)), *(round(0.05 + 0.05 * i, 2) for i in range(9))]


def outside(df: DataFrame, outers: int) -> Column:
    """The outer folds that a row of df isn't in. Its fold is a number, or an array of several that it is in."""
    every = F.sequence(F.lit(0), F.lit(outers - 1))
    return F.array_except(every, F.col("fold")) if df.schema["fold"].dataType.typeName() == "array" else F.array_remove(every, F.col("fold"))


def observed_grid(values: DataFrame, column: str, steps: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, value): nearest-rank quantiles of what was observed, rounded to 6 places, each once."""
    keys = keys or []
    by = values.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    by, large = once(by, "observed")
    cum = running(by, keys, bucket(F.col("v"), edges(by, "v", large=large)), [F.col("v")], {"upto": F.col("n")})
    total = by.groupBy(*keys).agg(F.sum("n").alias("all"))
    cum = cum.join(F.broadcast(total), keys) if keys else cum.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    spread = [i / (steps - 1) for i in range(steps)] if steps > 1 else [0.5]
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.bround(F.lit(q) * (F.col("all") - 1)).cast("long").alias("place")) for i, q in enumerate(spread)))
    hits = cum.select(*keys, F.explode(F.filter(wanted, lambda x: (x["place"] < F.col("upto")) & (x["place"] >= F.col("upto") - F.col("n")))).alias("_at"), F.bround("v", 6).alias("value"))
    return hits.select(*keys, "_at.i", "value").groupBy(*keys, "value").agg(F.min("i").alias("i")).select(*keys, "i", "value")


def inner_grid(values: DataFrame, column: str, steps: int, keys: list[str], folds: int) -> DataFrame:
    """As observed_grid() for each outer fold on the rows of the others, as (keys, outer, i, value). With an array of folds a
    row is in several at once (as under several seeds). values are read three times: they should be kept."""
    return quantiles(values, [column], steps, keys, folds).drop("column")


def gate_grid(thetas: list[float], conflicts: list[float], df: DataFrame) -> DataFrame:
    """Every pair of a theta and a conflict gate as a table."""
    spark = df.sparkSession
    return spark.createDataFrame([(a, b) for a in thetas for b in conflicts], "theta double, conflict double")


def best(scored: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    by = Window.partitionBy(*keys or [F.lit(0)]).orderBy(*order)
    return scored.withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k")


def search_gates(results: DataFrame, grid: DataFrame, keys: list[str], support: str = "m_support", refute: str = "m_refute", theta: str = "m_theta", k: str = "k_doc", tie: float = 1e-6, times: str | None = None) -> DataFrame:
    """Of each key the grid point (theta, conflict, and k_eval if the grid has it) of the best macro F1; ties go to the
    least theta, then conflict, then k_eval. grid: a small table (theta, conflict), by key if it has the keys. Each row
    counts once, or so many times."""
    shared = [c for c in keys if c in grid.columns]
    alert = [c for c in ("k_eval",) if c in grid.columns]
    rows = results.select(*keys, "gold_state", F.col(support).alias("s"), F.col(refute).alias("r"), F.col(theta).alias("t"), F.col(k).alias("k"), *([times] if times else []))
    tried = rows.join(F.broadcast(grid), shared) if shared else rows.crossJoin(F.broadcast(grid))
    state = gated_state(F.col("t") >= F.col("theta"), F.col("k") >= F.col("conflict"), verdict(F.col("s"), F.col("r"), tie))
    scored = classification_report(tried.withColumn("predicted", metric_label(state)), [*keys, "theta", "conflict", *alert], times=times)
    return best(scored, keys, F.desc(F.round("macro_f1", 12)), F.col("theta"), F.col("conflict"), *map(F.col, alert))


def search_observed(results: DataFrame, thetas: DataFrame, conflicts: DataFrame, keys: list[str], outers: int = 0, tie: float = 1e-6) -> DataFrame:
    """As search_gates() with grids (keys, outer if there are outers, i, value) for m_theta and k_doc: every pair is tried.
    With outers, each is searched on the rows of the other folds. Rows are counted by how many thresholds they reach, so
    what is tried is a small table, however many claims there are."""
    if outers:
        return search_outside(results, thetas, conflicts, keys, outers, tie=tie)[0]
    on = keys or ["_one"]
    grids = _lists(thetas if keys else thetas.withColumn("_one", F.lit(1)), "thetas", on).join(_lists(conflicts if keys else conflicts.withColumn("_one", F.lit(1)), "conflicts", on), on)
    rows = (results if keys else results.withColumn("_one", F.lit(1))).join(F.broadcast(grids), on)
    reached = lambda values, x: F.coalesce(F.size(F.filter(values, lambda v: v <= F.col(x))), F.lit(0))
    counts = rows.groupBy(*on, "gold_state", verdict(F.col("m_support"), F.col("m_refute"), tie).alias("direction"), reached("thetas", "m_theta").alias("t"), reached("conflicts", "k_doc").alias("k")).agg(F.count("*").alias("n"))
    return _best_point(counts, grids, on, keys)


def _lists(grid: DataFrame, name: str, by: list[str]) -> DataFrame:
    return grid.groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias(name))


def _cut(ti: Column, ki: Column) -> Column:
    """The label of rows that reach t and k thresholds, by those numbered ti and ki."""
    return metric_label(gated_state(F.col("t") > ti, F.col("k") > ki, F.coalesce("direction", F.lit("undetermined"))))


def _best_point(counts: DataFrame, grids: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    points = grids.select(*on, F.posexplode("thetas").alias("ti", "theta"), "conflicts").select(*on, "ti", "theta", F.posexplode("conflicts").alias("ki", "conflict"))
    tried = counts.join(F.broadcast(points), on).withColumn("predicted", _cut(F.col("ti"), F.col("ki")))
    scored = classification_report(tried, [*keys, "theta", "conflict"], times="n")
    return best(scored, keys, F.desc(F.round("macro_f1", 12)), F.col("theta"), F.col("conflict"))


def search_outside(rows: DataFrame, thetas: DataFrame, conflicts: DataFrame, keys: list[str], folds: int, methods: dict[str, tuple[str, str, str, str]] | None = None, tie: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """search_observed() of each outer fold on the rows of the others, and (keys, outer, gold_state, predicted, n) of the fold's
    own rows by what is best on the others. keys: those of the grids. methods: of each value of the key method the columns of
    rows that are its masses; without them rows have the key, and m_support, m_refute, m_theta and k_doc. Rows are counted
    in one pass, with no copy of a row for each fold."""
    by = [*keys, "outer"]
    grids = kept(_lists(thetas, "thetas", by).join(_lists(conflicts, "conflicts", by), by), "grids")
    own = [k for k in keys if not (methods and k == "method")]
    lists = {(r["method"] if methods else "", *(r[k] for k in own), r["outer"]): (r["thetas"], r["conflicts"]) for r in grids.collect()}
    counts = reached(rows, methods or {"": ("m_support", "m_refute", "m_theta", "k_doc")}, lists, own, folds, tie)
    counts = counts.withColumnRenamed("_m", "method") if methods else counts.drop("_m")
    chosen = kept(_best_point(counts.withColumn("n", F.col("n") - F.col("own")).filter("n > 0"), grids, by, by), "gates-chosen")
    at = counts.filter("own > 0").join(F.broadcast(chosen.join(grids, by).select(*by, *((F.array_position(f"{c}s", F.col(c)) - 1).alias(i) for c, i in (("theta", "ti"), ("conflict", "ki"))))), by)
    judged = at.withColumn("predicted", _cut(F.col("ti"), F.col("ki"))).groupBy(*by, "gold_state", "predicted").agg(F.sum("own").alias("n"))
    return chosen, judged


def decision_candidates(scores: DataFrame, keys: list[str], decisions: list[float] = DECISIONS, conflicts: list[float] = CONFLICTS, margins: list[float] = (0.1,), outers: int = 0) -> DataFrame:
    """(keys, method, decision, conflict, margin, macro_f1, accuracy) of every point: decisions for each method, and for
    conflict_aware all triples (others: conflict and margin are null). scores: (keys, method, gold_state, score_support,
    score_refute, score_unknown; fold if there are outers, of which each is searched on the other folds' rows). Rows are
    counted by the thresholds that they reach before any point is tried."""
    s, r, u = (F.col(f"score_{x}") for x in ("support", "refute", "unknown"))
    decided, _ = baseline_decision(s, r, u, BaselineThresholds(), F.lit(0.0))
    aware = F.col("method") == "conflict_aware"
    low, gap = F.least(s, r), F.abs(s - r)
    at_least = lambda values, x: sum((x >= v).cast("int") for v in sorted(values))
    within = sum((gap <= F.lit(m) + 1e-12).cast("int") for m in margins)
    fold, cells = ["fold"] if outers else [], ["method", "gold_state", "decided", "d", "c", "m"]
    counts = scores.select(*keys, *fold, "method", "gold_state", decided.alias("decided"), at_least(decisions, F.greatest(s, r, u)).alias("d"), F.when(aware, at_least(conflicts, low)).otherwise(0).alias("c"), F.when(aware, within).otherwise(0).alias("m"))
    if outers:  # what lies outside a fold is all less the fold's own: a row counts among all (fold -1) and in each of its folds
        own = F.col("fold") if scores.schema["fold"].dataType.typeName() == "array" else F.array("fold")
        counts = counts.withColumn("fold", F.explode(F.concat(F.array(F.lit(-1)), own)))
    counts = counts.groupBy(*keys, *fold, *cells).agg(F.count("*").alias("n"))
    if outers:
        every = F.sequence(F.lit(0), F.lit(outers - 1))
        each = counts.withColumns({"outer": F.explode(F.when(F.col("fold") < 0, every).otherwise(F.array("fold"))), "n": F.when(F.col("fold") < 0, F.col("n")).otherwise(-F.col("n"))})
        counts = each.groupBy(*keys, "outer", *cells).agg(F.sum("n").alias("n")).filter("n > 0")
    spark, by = scores.sparkSession, [*keys, "outer"] if outers else keys
    numbered = lambda values: list(enumerate(sorted(values)))
    # margins ascend: a row within the widest so many of them lies within the last so many
    points = [("conflict_aware", i, a, j, b, len(margins) - k - 1, c) for i, a in numbered(decisions) for j, b in numbered(conflicts) for k, c in numbered(margins)]
    points += [(m, i, a, None, None, None, None) for m in ("weighted_average", "majority_vote", "single_evaluator") for i, a in numbered(decisions)]
    grid = spark.createDataFrame(points, "method string, di int, decision double, ci int, conflict double, mi int, margin double")
    state = F.when((F.col("c") > F.col("ci")) & (F.col("m") > F.col("mi")), "conflicting").when(F.col("d") <= F.col("di"), "insufficient").otherwise(F.col("decided"))
    tried = counts.join(F.broadcast(grid), "method").withColumn("predicted", state)
    return classification_report(tried, [*by, "method", "decision", "conflict", "margin"], times="n")


def _plateau(candidates: DataFrame, by: list[str]) -> DataFrame:
    top = Window.partitionBy(*(by or [F.lit(0)]))
    return candidates.withColumn("_f", F.round("macro_f1", 12)).withColumn("_top", F.max("_f").over(top)).filter("_f = _top").drop("_f", "_top")


def best_decisions(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of each key the lower median of the plateau of the best macro F1, in the order of decision, conflict and margin."""
    flat = _plateau(candidates, by)
    order = Window.partitionBy(*(by or [F.lit(0)]))
    place = flat.withColumns({"_k": F.row_number().over(order.orderBy("decision", "conflict", "margin")), "plateau": F.count("*").over(order)})
    return place.filter("_k = (plateau + 1) div 2").drop("_k")


def shared_decision(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, decision): the middle of what the plateaus of all methods share, or else the upper median of their bests."""
    by = [*keys, "method"]
    spans = _plateau(candidates, by).groupBy(*by).agg(F.min("decision").alias("a"), F.max("decision").alias("b"))
    spans = spans.join(best_decisions(candidates, by).select(*by, F.col("decision").alias("own")), by)
    own = F.array_sort(F.collect_list("own"))
    out = spans.groupBy(*keys).agg(F.max("a").alias("low"), F.min("b").alias("high"), own.alias("own"))
    middle = F.element_at("own", (F.floor(F.size("own") / 2) + 1).cast("int"))
    return out.select(*keys, F.when(F.col("low") <= F.col("high"), F.bround((F.col("low") + F.col("high")) / 2, 6)).otherwise(middle).alias("decision"))


def search_decisions(scores: DataFrame, keys: list[str], conflict_aware: bool = False, decisions: list[float] = DECISIONS, conflicts: list[float] = CONFLICTS, margins: list[float] = (0.1,)) -> DataFrame:
    """Of each key the lower median of the plateau of the best macro F1 over decision (and conflict and margin) thresholds.
    scores: (keys, gold_state, score_support, score_refute, score_unknown)."""
    named = scores.withColumn("method", F.lit("conflict_aware" if conflict_aware else "weighted_average"))
    return best_decisions(decision_candidates(named, keys, decisions, conflicts, margins), keys).drop("method", "n")


def grid_health(grid: DataFrame, chosen: DataFrame, observed: DataFrame, column: str) -> DataFrame:
    """(threshold, low, high, seen_low, seen_high, out_of_range, at_border, flat) of a search over one threshold. grid:
    (value, macro_f1) of all points tried; chosen: (value); observed: results with the column that the threshold cuts."""
    tried = grid.agg(F.min("value").alias("low"), F.max("value").alias("high"), (F.max("macro_f1") - F.min("macro_f1") < 1e-9).alias("flat"))
    seen = observed.agg(F.min(column).alias("seen_low"), F.max(column).alias("seen_high"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    all_ = one(tried).join(one(seen), "_one").join(one(chosen.select("value")), "_one").drop("_one")
    outside = (F.col("low") > F.col("seen_high")) | (F.col("high") < F.col("seen_low"))
    return all_.select(F.lit(column).alias("threshold"), "low", "high", "seen_low", "seen_high", outside.alias("out_of_range"), F.col("value").isin(F.col("low"), F.col("high")).alias("at_border"), "flat")
