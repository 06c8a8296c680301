"""AUROC and risk at coverages of many resamples, from one row for each score that is shuffled.

A row carries its key's two words, from which a task draws its weights in all resamples (functions/draws.py), so rows aren't
copied for each resample. Rows are dealt to parts that follow one another in the order; of each part only sums by resample
are left, and parts are put together from these. Parts are ranges of about equally many rows; a value that very many rows
share has parts for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.draws import drawn_weights, words
from evidra.operators.tables import kept

#: Rows of a part, about, and parts of a key at most.
PART_ROWS, PARTS = 250_000, 4096


class Parts:
    """Places in the order of a key's scores: which rows lie in which part. Even numbers are ranges, odd ones the rows of one
    value, which are split further by what the caller gives as their share (0 to 1)."""

    def __init__(self, quantiles: list[float]):
        values, times = np.unique(np.asarray(quantiles, float), return_counts=True)
        self.edges, self.times, self.step = values, times, int(times.max(initial=1))

    def place(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's part, and into how many it is split."""
        at = np.searchsorted(self.edges, score)
        if not len(self.edges):
            return 2 * at, np.ones(len(score), np.int64)
        near = np.minimum(at, len(self.edges) - 1)
        heavy = (self.edges[near] == score) & (self.times[near] > 1)
        return 2 * at + heavy, np.where(heavy, self.times[near], 1)


def _laid_out(rows: DataFrame, keys: list[str], score: str, order: str | None) -> tuple[DataFrame, list[Parts], list[float], DataFrame]:
    """Of rows that are kept: these with their key's number _g, the parts of each key, quantiles of the order, and the keys by
    number."""
    n = min(PARTS, max((r["count"] for r in rows.groupBy(*keys).count().collect()), default=0) // PART_ROWS)
    at = F.array(*(F.lit(i / (n + 1)) for i in range(1, n + 1)))
    quantiles = lambda c: F.percentile_approx(c, at, 4 * (n + 1)).alias(f"_q_{c}") if n else F.array().cast("array<double>").alias(f"_q_{c}")
    columns = [score, *([order] if order else [])]
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(quantiles(c) for c in columns)).sort(*keys).collect()
    names = [tuple(r[k] for k in keys) for r in found]
    orders = max(found, key=lambda r: r["_n"])[f"_q_{order}"] if order and found else []
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    numbered = rows.sparkSession.createDataFrame([(*v, i) for i, v in enumerate(names)], f"{kinds}, _g int")
    return rows.join(F.broadcast(numbered), keys), [Parts(r[f"_q_{score}"]) for r in found], list(orders), numbered


def _packed(df: DataFrame, unit: list[str], flag: str):
    """Both words and a flag in one number. Without a unit nothing is drawn: then the second word is the row's number in its
    task, for the shares of a value."""
    a, b = words(*map(F.col, unit)) if unit else (F.lit(0).cast("long"), F.monotonically_increasing_id() % 2**31 * 740_000_007 % 2**31)
    return (F.shiftleft(a, 32) + F.shiftleft(b, 1) + F.col(flag).cast("long")).alias("_x")


def _unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 32, (x >> 1) & (2**31 - 1), x & 1


def _numbers(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _dealt(parts: list[Parts], g: np.ndarray, score: np.ndarray, share) -> np.ndarray:
    """Each row's part as one number: of its key, its place, and its share of the rows of a value."""
    out = np.zeros(len(g), np.int64)
    for i in np.unique(g):
        own = np.flatnonzero(g == i)
        at, split = parts[i].place(score[own])
        out[own] = at * parts[i].step + (share(own) * split).astype(np.int64)
    return out


def auroc_by_resample(rows: DataFrame, resamples: int, seed: int, keys: list[str], unit: list[str]) -> DataFrame:
    """(keys, resample, auroc) of rows (keys, unit, score, positive 0/1); ties are averaged, and it is null where a resample has
    one class. A resample that draws no row has none."""
    plain = rows.select(*keys, F.coalesce("score", F.lit(float("-inf"))).alias("score"), _packed(rows, unit, "positive"))
    numbered, parts, _, names = _laid_out(kept(plain, "scores"), keys, "score", None)
    steps = [p.step for p in parts]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, score, x = (_numbers(batch, c) for c in ("_g", "score", "_x"))
            part = _dealt(parts, g, score, lambda own: _unpacked(x[own])[1] / 2.0**31)
            yield pa.record_batch([pa.array(v) for v in (g.astype(np.int32), part, score, x)], names=["_g", "part", "score", "_x"])

    def count(table: pa.Table) -> pa.Table:
        score, x = _numbers(table, "score"), _numbers(table, "_x")
        order = np.argsort(score, kind="stable")
        score, (a, b, positive) = score[order], _unpacked(x[order])
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        g, out = table.column("_g")[0].as_py(), []
        place = table.column("part")[0].as_py() // steps[g]
        for r in range(-1, resamples):
            w = drawn_weights(a, b, r, seed).astype(np.int64)
            p = w * positive
            if place % 2:  # of one value: what its parts have meets later
                out.append((int(p.sum()), int((w - p).sum()), 0))
                continue
            p, n = np.add.reduceat(p, starts), np.add.reduceat(w - p, starts)
            out.append((int(p.sum()), int(n.sum()), int((p * (2 * (np.cumsum(n) - n) + n)).sum())))
        p, n, twice = zip(*out, strict=True)
        same = len(out)
        return pa.table({"_g": pa.array([g] * same, pa.int32()), "place": pa.array([place] * same, pa.int64()), "resample": pa.array(range(-1, resamples), pa.int32()), "p": pa.array(p, pa.int64()), "n": pa.array(n, pa.int64()), "twice": pa.array(twice, pa.int64())})

    dealt = numbered.select("_g", "score", "_x").mapInArrow(deal, "_g int, part long, score double, _x long")
    sums = dealt.groupBy("_g", "part").applyInArrow(count, "_g int, place long, resample int, p long, n long, twice long")
    return _auroc(sums, names, keys)


def _auroc(sums: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, resample, auroc) from what parts have (_g, place, resample, p, n, twice)."""
    sums = sums.groupBy("_g", "resample", "place").agg(*(F.sum(c).alias(c) for c in ("p", "n", "twice")))
    before = Window.partitionBy("_g", "resample").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # a positive beats the negatives of the parts below it
    twice = F.when(F.col("place") % 2 == 1, F.col("p") * F.col("n")).otherwise(F.col("twice")) + 2 * F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0))
    each = sums.withColumn("twice", twice).groupBy("_g", "resample").agg(*(F.sum(c).alias(c) for c in ("p", "n", "twice"))).filter("p + n > 0")
    return each.join(F.broadcast(names), "_g").select(*keys, "resample", F.try_divide(F.col("twice") / 2, F.col("p").cast("double") * F.col("n")).alias("auroc"))


def risk_by_resample(rows: DataFrame, coverages: list[float], resamples: int, seed: int, keys: list[str], unit: list[str]) -> DataFrame:
    """(keys, resample, coverage, risk) of rows (keys, unit, risk_score, order_key, correct 0/1): the error rate of the least
    risky share of what each resample draws; order_key is a number."""
    return selective_by_resample(rows, coverages, resamples, seed, keys, unit)[1]


def selective_by_resample(rows: DataFrame, coverages: list[float], resamples: int, seed: int, keys: list[str], unit: list[str]) -> tuple[DataFrame, DataFrame]:
    """auroc_by_resample() of errors by their risk_score, and risk_by_resample(), from one order of the same rows: a task
    draws a part's weights once for the sums of both, and again only for those resamples of which a coverage ends in it."""
    plain = rows.select(*keys, F.coalesce("risk_score", F.lit(float("-inf"))).alias("risk_score"), "order_key", _packed(rows, unit, "correct"))
    numbered, parts, orders, names = _laid_out(kept(plain, "risks"), keys, "risk_score", "order_key")
    orders = np.asarray(orders, float)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, score, key, x = (_numbers(batch, c) for c in ("_g", "risk_score", "order_key", "_x"))
            part = _dealt(parts, g, score, lambda own: np.searchsorted(orders, key[own]) / (len(orders) + 1))
            yield pa.record_batch([pa.array(v) for v in (g.astype(np.int32), part, score, key, x)], names=["_g", "part", "risk_score", "order_key", "_x"])

    steps = [p.step for p in parts]

    def weigh(table: pa.Table) -> pa.Table:
        """What a part weighs in each resample (w), how much of it is correct, and twice the errors that lie above correct ones."""
        score, key = _numbers(table, "risk_score"), _numbers(table, "order_key")
        order = np.lexsort((key, score))
        score, (a, b, correct) = score[order], _unpacked(_numbers(table, "_x")[order])
        a, b = a.astype(np.uint32), b.astype(np.uint32)
        new = np.r_[True, score[1:] != score[:-1]]
        starts = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        low, high = starts[at], np.r_[starts[1:], len(score)][at]
        g, part = table.column("_g")[0].as_py(), table.column("part")[0].as_py()
        place, out, upto = part // steps[g], np.zeros((resamples + 1, 3), np.int64), np.zeros(len(score) + 1)
        for r in range(-1, resamples):
            w = drawn_weights(a, b, r, seed).astype(np.int64)
            hits = w * correct
            np.cumsum(hits, out=upto[1:])
            # of one value (odd places): what its parts have meets later
            out[r + 1] = w.sum(), upto[-1], 0 if place % 2 else np.dot((w - hits).astype(float), upto[low] + upto[high])
        same = len(out)
        return pa.table({"_g": pa.array([g] * same, pa.int32()), "part": pa.array([part] * same, pa.int64()), "place": pa.array([place] * same, pa.int64()), "resample": pa.array(range(-1, resamples), pa.int32()), "w": pa.array(out[:, 0]), "hits": pa.array(out[:, 1]), "twice": pa.array(out[:, 2])})

    def find(table: pa.Table, known: pa.Table) -> pa.Table:
        score, key = _numbers(table, "risk_score"), _numbers(table, "order_key")
        order = np.lexsort((key, score))
        a, b, correct = _unpacked(_numbers(table, "_x")[order])
        out = []
        a, b = a.astype(np.uint32), b.astype(np.uint32)
        for r, w_before, hits_before, own, n in zip(*(known.column(c).to_pylist() for c in ("resample", "w_before", "hits_before", "w", "n")), strict=True):
            want = np.maximum(1, np.rint(n * np.asarray(coverages))).astype(np.int64)
            ends = np.flatnonzero((want > w_before) & (want <= w_before + own))
            if not len(ends):
                continue
            w = drawn_weights(a, b, r, seed).astype(np.int64)
            k, hits = w_before + np.cumsum(w), hits_before + np.cumsum(w * correct)
            for c in ends:
                i = np.searchsorted(k, want[c])
                out.append((r, coverages[c], float(1 - (hits[i] - (k[i] - want[c]) * correct[i]) / want[c])))
        r, c, risk = zip(*out, strict=True) if out else ((), (), ())
        g = table.column("_g")[0].as_py() if table.num_rows else 0
        return pa.table({"_g": pa.array([g] * len(out), pa.int32()), "resample": pa.array(r, pa.int32()), "coverage": pa.array(c, pa.float64()), "risk": pa.array(risk, pa.float64())})

    kind = "_g int, part long, risk_score double, order_key long, _x long"
    dealt = numbered.select("_g", "risk_score", F.col("order_key").cast("long").alias("order_key"), "_x").mapInArrow(deal, kind)
    # a few numbers a part and resample, for both metrics
    sums = kept(dealt.groupBy("_g", "part").applyInArrow(weigh, "_g int, part long, place long, resample int, w long, hits long, twice long"), "part-sums")
    by = Window.partitionBy("_g", "resample")
    before = by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    known = sums.select("_g", "part", "resample", "w", upto("w").alias("w_before"), upto("hits").alias("hits_before"), F.sum("w").over(by).alias("n")).filter("n > 0")
    found = dealt.groupBy("_g", "part").cogroup(known.groupBy("_g", "part")).applyInArrow(find, "_g int, resample int, coverage double, risk double")
    aurocs = _auroc(sums.select("_g", "place", "resample", (F.col("w") - F.col("hits")).alias("p"), F.col("hits").alias("n"), "twice"), names, keys)
    return aurocs, found.join(F.broadcast(names), "_g").select(*keys, "resample", "coverage", "risk")
