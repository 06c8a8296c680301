"""Bootstrap of metrics at any size, as aggregates that SQL can repeat.

A row's weight in a resample is a Poisson draw of its key and the resample's number (functions/draws.py), so methods are
paired without a table of draws, a lost task draws the same again, and any engine gets the same numbers. Metrics of labels need
only the weights of each combination of labels, which a task draws and adds up before the shuffle; metrics of an order (AUROC, risk
at coverage) are worked out part by part of the order, where a task draws the weights (ordered.py). What was observed is resample -1, where every row has weight
1, so one plan gives both. Intervals and p are taken from a few values a resample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from evidra.functions.draws import drawn_weights, words
from evidra.operators.metrics import LABELS, classification_report, coverages
from evidra.operators.ordered import auroc_by_resample, risk_by_resample, selective_by_resample
from evidra.operators.tables import kept

GOLD = LABELS[:4]


def summarised(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, observed, low, high, p_value, n_resamples) of values (keys, resample, value): what resample -1 has, and of the
    others that have a value the interval by place, and twice the smaller share on either side of 0 (itself included)."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    drawn = (F.col("resample") >= 0) & F.col("value").isNotNull()
    ranked = values.withColumn("_drawn", drawn)
    ranked = ranked.withColumns({"_n": F.count(F.when(F.col("_drawn"), 1)).over(by), "_k": F.sum(F.col("_drawn").cast("int")).over(by.orderBy(F.desc("_drawn"), "value", "resample").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1})
    at = lambda place: F.max(F.when(F.col("_drawn") & (F.col("_k") == place), F.col("value")))
    n = F.col("_n")
    count = lambda inside: F.count(F.when(F.col("_drawn") & inside, 1))
    p = F.least(F.lit(1.0), F.try_divide(2 * F.least(count(F.col("value") <= 0), count(F.col("value") >= 0)), F.max(n)))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("resample") < 0, F.col("value"))).alias("observed"), at(F.floor(n * 0.025)).alias("low"), at(F.least(F.floor(n * 0.975), n - 1)).alias("high"),
        p.alias("p_value"), F.max(n).alias("n_resamples"),
    )


def label_counts(rows: DataFrame, by: list[str], unit: list[str], resamples: int, seed: int) -> DataFrame:
    """(by, resample, w): what rows of each combination weigh together in each resample. A task draws the weights of a batch of
    rows at once and adds them up, so no row is copied for each resample."""
    a, b = words(*map(F.col, unit))
    plain = rows.select(*by, a.alias("_a"), b.alias("_b"))
    kinds = plain.select(*by).schema
    schema = to_arrow_schema(kinds).append(pa.field("resample", pa.int32())).append(pa.field("w", pa.int64()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            code, coded = np.zeros(batch.num_rows, np.int64), [batch.column(c).dictionary_encode(null_encoding="encode") for c in by]
            for c in coded:
                _, code = np.unique(code * len(c.dictionary) + c.indices.to_numpy(), return_inverse=True)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            keys, at = np.unique((batch.column("_a").to_numpy() << 32) + batch.column("_b").to_numpy(), return_inverse=True)
            at, x, y = at[order], keys >> 32, keys & (2**32 - 1)
            sums = np.stack([np.add.reduceat(drawn_weights(x, y, r, seed)[at], starts, dtype=np.int64) for r in range(-1, resamples)], axis=1)
            for i, own in zip(order[starts], sums, strict=True):
                key = tuple(c[int(i)].as_py() for c in coded)
                found[key] = found[key] + own if key in found else own
        for key, own in found.items():
            yield pa.record_batch([*(pa.array([v] * len(own), schema.field(i).type) for i, v in enumerate(key)), pa.array(range(-1, resamples), pa.int32()), pa.array(own)], schema=schema)

    counted = plain.mapInArrow(weigh, StructType([*(StructField(f.name, f.dataType) for f in kinds), StructField("resample", IntegerType()), StructField("w", LongType())]))
    return counted.groupBy(*by, "resample").agg(F.sum("w").alias("w"))


def label_scores(predictions: DataFrame, keys: list[str], sides: list[str], unit: list[str], resamples: int, seed: int, labels: list[str] = GOLD) -> DataFrame:
    """(keys, side, resample, metric, value, n) of the columns sides of predictions (keys, gold_state, sides, unit): accuracy,
    and Macro-F1 over a fixed list of labels (0 for one that a resample lacks)."""
    counts = label_counts(predictions, [*keys, "gold_state", *sides], unit, resamples, seed).filter("w > 0")
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("predicted")) for s in sides)))
    long = counts.withColumn("_s", each).select(*keys, "resample", "gold_state", "w", "_s.*")
    # a few numbers a resample, from one pass over the rows
    report = kept(classification_report(long, [*keys, "side", "resample"], labels, times="w"), "label-scores")
    both = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "macro_f1"))))
    return report.withColumn("_m", both).select(*keys, "side", "resample", "_m.*", "n")


def differences(values: DataFrame, keys: list[str], reference: str, name: str = "side") -> DataFrame:
    """(keys, rival, resample, reference_value, rival_value, value) of values (keys, name, resample, value): the reference's
    value less that of each other name."""
    own = values.filter(F.col(name) == reference).select(*keys, "resample", F.col("value").alias("reference_value"))
    rest = values.filter(F.col(name) != reference).select(*keys, F.col(name).alias("rival"), "resample", F.col("value").alias("rival_value"))
    return rest.join(own, [*keys, "resample"]).withColumn("value", F.col("reference_value") - F.col("rival_value"))


def bootstrap_interval(predictions: DataFrame, resamples: int = 5000, seed: int = 42, unit: list[str] = ["claim_id"]) -> DataFrame:  # noqa: B006
    """(metric, observed, low, high, n_resamples, n_claims) of one method's predictions (gold_state, predicted, unit); no
    predictions give no rows."""
    scores = label_scores(predictions, [], ["predicted"], unit, resamples, seed)
    n = scores.filter("resample < 0").select("metric", F.col("n").alias("n_claims"))
    return summarised(scores, ["metric"]).join(n, "metric").select("metric", "observed", "low", "high", "n_resamples", "n_claims")


def paired_bootstrap(predictions: DataFrame, resamples: int = 5000, seed: int = 42, unit: list[str] = ["claim_id"], keys: list[str] = [], labels: list[str] = GOLD) -> DataFrame:  # noqa: B006
    """Method a less method b, in accuracy and in Macro-F1 over a fixed list of labels: the difference on all claims, its
    interval and p on resamples. predictions: (keys, gold_state, predicted_a, predicted_b, unit)."""
    scores = label_scores(predictions, keys, ["predicted_a", "predicted_b"], unit, resamples, seed, labels)
    n = scores.filter("resample < 0 AND side = 'predicted_a'").select(*keys, "metric", F.col("n").alias("n_claims"))
    found = summarised(differences(scores, [*keys, "metric"], "predicted_a"), [*keys, "metric"])
    return found.join(n, [*keys, "metric"]).select(*keys, "metric", F.col("observed").alias("difference"), "low", "high", "p_value", "n_resamples", "n_claims")


def compared(values: DataFrame, keys: list[str], reference: str) -> DataFrame:
    """(keys, reference, rival, value of both, delta, low, high, p_value, n_resamples) of values (keys, name, resample,
    value). What was observed has to have a value."""
    each = differences(kept(values, "resamples"), keys, reference, "name")
    seen = each.filter("resample < 0").select(*keys, "rival", F.col("reference_value").alias("value_reference"), "rival_value")
    found = summarised(each, [*keys, "rival"]).join(seen, [*keys, "rival"])
    delta = F.coalesce("observed", F.raise_error(F.lit("both classes have to occur")).cast("double"))
    return found.select(*keys, F.lit(reference).alias("reference"), "rival", "value_reference", F.col("rival_value").alias("value_rival"), delta.alias("delta"), "low", "high", "p_value", "n_resamples")


def auroc_resamples(rows: DataFrame, resamples: int, seed: int, keys: list[str] = ["name"], unit: list[str] = ["id"]) -> DataFrame:  # noqa: B006
    """(keys, resample, auroc) of rows (keys, unit, score, positive 0/1); null where a resample has one class."""
    return auroc_by_resample(rows, resamples, seed, keys, unit)


def aurc_resamples(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(name, resample, aurc) of rows (name, id, risk_score, order_key, correct 0/1)."""
    found = risk_by_resample(rows, coverages(), resamples, seed, ["name"], ["id"])
    return found.groupBy("name", "resample").agg(F.avg("risk").alias("aurc"))


def paired_auroc_bootstrap(rows: DataFrame, reference: str, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """The AUROC of a reference less that of each other name, on all rows and on resamples; those of one class are
    skipped. rows: (name, id, score, positive), with the same ids for each name."""
    found = compared(auroc_resamples(rows, resamples, seed).withColumnRenamed("auroc", "value"), [], reference)
    return found.withColumnsRenamed({"value_reference": "auroc_reference", "value_rival": "auroc_rival"})


def paired_selective_bootstrap(rows: DataFrame, reference: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """As paired_auroc_bootstrap() for risk scores (name, id, risk_score, order_key, correct): AUROC of errors and area
    under the risk at coverages, as (metric, ...)."""
    aurocs, risks = selective_by_resample(rows, coverages(), resamples, seed, ["name"], ["id"])
    a = aurocs.select(F.lit("auroc").alias("metric"), "name", "resample", F.col("auroc").alias("value"))
    b = risks.groupBy("name", "resample").agg(F.avg("risk").alias("value")).select(F.lit("aurc").alias("metric"), "name", "resample", "value")
    return compared(a.unionByName(b), ["metric"], reference)


def compare_runs(reference: DataFrame, rival: DataFrame, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """paired_bootstrap() of each method that two runs (method, sample_id, claim_id, gold_state, predicted) share, as
    (method, metric, ...), from one plan. Claims that only one run has are an error as they are read."""
    key = ["method", "sample_id", "claim_id"]
    shared = reference.select("method").distinct().intersect(rival.select("method").distinct())
    side = lambda df, name, *more: df.join(F.broadcast(shared), "method", "left_semi").select(*key, *more, F.col("predicted").alias(f"predicted_{name}"), F.lit(1).alias(f"_{name}"))
    both = side(reference, "a", "gold_state").join(side(rival, "b"), key, "full")
    lost = F.raise_error(F.concat(F.lit("the runs don't have the same claims: "), F.concat_ws("/", *key)))
    both = both.withColumn("predicted_a", F.when(F.col("_a").isNull() | F.col("_b").isNull(), lost).otherwise(F.col("predicted_a")))
    return paired_bootstrap(both, resamples, seed, ["claim_id"], ["method"])
