"""Thresholds of many outer folds from few passes over wide rows: quantiles of what lies outside each fold, and counts of the rows
that reach them.

A row has several columns to be cut, and a number or an array of folds that it is in. What lies outside a fold is all less the
fold's own, so no row is copied for the folds that it isn't in. Quantiles are exact: rows are counted by place between edges (which
lie about evenly, and have the rows equal to an edge for themselves) and fold; this tells the place of each quantile, and only
rows of such places are shuffled and sorted. A pass counts in its tasks, so what is shuffled of it doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.tables import kept

#: Edges of a column, and their accuracy (Spark's percentile_approx). Neither changes a result.
EDGES, ACCURACY = 512, 2048

# Directions by their number.
DIRECTIONS = ["undetermined", "supported", "refuted"]


def _keyed(rows: DataFrame, keys: list[str], names: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(names), keys) if keys else rows.withColumn("_g", F.lit(0))


def _names(rows: DataFrame, keys: list[str], found: list[tuple]) -> DataFrame:
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.sparkSession.createDataFrame([(*v, i) for i, v in enumerate(found)], f"{kinds}_g int")


def _lists(rows: DataFrame):
    """The folds of a row as an array."""
    return F.col("fold") if rows.schema["fold"].dataType.typeName() == "array" else F.array("fold")


def _numbers(batch, name: str) -> np.ndarray:
    """A column; null is NaN where it is a double."""
    return batch.column(name).to_numpy(zero_copy_only=False)


def _inside(batch, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are in which folds, as two arrays side by side. Numbers from folds on are no fold."""
    column = batch.column("fold")
    at = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    of = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    known = (of >= 0) & (of < folds)
    return at[known], of[known]


@dataclass
class _Places:
    """Places of a column's values: even ones lie between edges, odd ones have the rows equal to an edge."""

    edges: np.ndarray
    #: slots by place, -1 for those that no quantile needs
    slots: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __len__(self) -> int:
        return 2 * len(self.edges) + 1

    def of(self, v: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.edges, v)
        equal = self.edges[np.minimum(at, len(self.edges) - 1)] == v if len(self.edges) else False
        return 2 * at + equal


def quantiles(rows: DataFrame, columns: list[str], steps: int, keys: list[str], folds: int) -> DataFrame:
    """(keys, column, outer, i, value): of each outer fold the nearest-rank quantiles of the columns on the rows of the others,
    rounded to 6 places, each once. rows are read three times: they should be kept."""
    rows = rows.select(*keys, _lists(rows).cast("array<int>").alias("fold"), *(F.col(c).cast("double").alias(c) for c in columns))
    wanted = ", ".join(f"{k / EDGES!r}D" for k in range(1, EDGES))
    found = rows.groupBy(*keys).agg(*(F.expr(f"percentile_approx(`{c}`, array({wanted}), {ACCURACY})").alias(c) for c in columns)).collect()
    names, spark = _names(rows, keys, [tuple(r[k] for k in keys) for r in found]), rows.sparkSession
    places = [[_Places(np.unique(np.asarray(r[c] or [], float))) for c in columns] for r in found]
    rows = _keyed(rows, keys, names).select("_g", "fold", *columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, own = ([[np.zeros((len(p), n), np.int64) for p in of] for of in places] for n in (1, max(folds, 1)))
        for batch in batches:
            g, (at, fold) = _numbers(batch, "_g"), _inside(batch, folds)
            for c, name in enumerate(columns):
                v = _numbers(batch, name)
                for i in np.unique(g):
                    known = (g == i) & ~np.isnan(v)
                    place = places[i][c].of(v)
                    all_[i][c][:, 0] += np.bincount(place[known], minlength=len(places[i][c]))
                    hit = known[at]
                    np.add.at(own[i][c], (place[at[hit]], fold[hit]), 1)
        for i, of in enumerate(places):
            for c in range(len(of)):
                for first, n in ((-1, all_[i][c]), (0, own[i][c])):
                    place, fold = np.nonzero(n)
                    same = len(place)
                    yield pa.record_batch([pa.array(np.full(same, i, np.int32)), pa.array(np.full(same, c, np.int32)), pa.array(place.astype(np.int32)), pa.array((fold + first).astype(np.int32)), pa.array(n[place, fold])], names=["_g", "c", "place", "fold", "n"])

    counts = rows.mapInArrow(count, "_g int, c int, place int, fold int, n long").groupBy("_g", "c", "place", "fold").agg(F.sum("n").alias("n")).toArrow()
    g, c, place, fold, n = (counts.column(x).to_numpy() for x in ("_g", "c", "place", "fold", "n"))
    hits, wants = [], []
    for i, of in enumerate(places):
        for j, p in enumerate(of):
            mine = (g == i) & (c == j)
            all_, own = np.zeros(len(p), np.int64), np.zeros((len(p), max(folds, 1)), np.int64)
            total = mine & (fold < 0)
            all_[place[total]], own[place[mine & ~total], fold[mine & ~total]] = n[total], n[mine & ~total]
            p.slots = np.full(len(p), -1)
            for f in range(max(folds, 1)):
                upto = np.cumsum(all_ - own[:, f])
                for k in range(steps) if upto[-1] > 0 else ():
                    rank = round((k / (steps - 1) if steps > 1 else 0.5) * (int(upto[-1]) - 1))
                    at = int(np.searchsorted(upto, rank + 1))
                    if at % 2:
                        hits.append((i, j, f, k, float(p.edges[at // 2])))
                        continue
                    if p.slots[at] < 0:
                        p.slots[at] = len(wants)
                        wants.append((i, j, []))
                    wants[p.slots[at]][2].append((f, k, rank - int(upto[at - 1] if at else 0)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = _numbers(batch, "_g")
            for c, name in enumerate(columns):
                v = _numbers(batch, name)
                for i in np.unique(g):
                    slot = np.where((g == i) & ~np.isnan(v), places[i][c].slots[places[i][c].of(v)], -1)
                    at = np.flatnonzero(slot >= 0)
                    yield pa.record_batch([pa.array(slot[at].astype(np.int32)), pa.array(v[at]), batch.column("fold").take(pa.array(at))], names=["slot", "v", "fold"])

    def find(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        v, (at, fold) = _numbers(batch, "v"), _inside(batch, folds)
        order = np.argsort(v, kind="stable")
        i, j, asked = wants[int(_numbers(batch, "slot")[0])]
        out, by = [], {}
        for f, k, rank in asked:
            if f not in by:
                outside = np.ones(len(v), np.int64)
                outside[at[fold == f]] = 0
                by[f] = np.cumsum(outside[order])
            out.append((i, j, f, k, float(v[order][np.searchsorted(by[f], rank + 1)])))
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("_g", "c", "outer", "i", "value"), zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)})

    kind = "_g int, c int, outer int, i int, value double"
    sorted_ = rows.mapInArrow(pick, "slot int, v double, fold array<int>").groupBy("slot").applyInArrow(find, kind)
    each = kept(spark.createDataFrame(hits, kind).unionByName(sorted_), "quantiles")
    named = F.element_at(F.array(*map(F.lit, columns)), F.col("c") + 1).alias("column")
    out = each.join(F.broadcast(names), "_g").select(*keys, named, "outer", "i", F.bround("value", 6).alias("value"))
    return out.groupBy(*keys, "column", "outer", "value").agg(F.min("i").alias("i")).select(*keys, "column", "outer", "i", "value")


def reached(rows: DataFrame, methods: dict[str, tuple[str, str, str, str]], grids: dict[tuple, tuple[list, list]], keys: list[str], folds: int, tie: float) -> DataFrame:
    """(_m, keys, outer, gold_state, direction, t, k, n, own): how many rows of each direction reach so many of a method's
    thresholds of an outer fold, all of them (n) and those in the fold (own). methods: of each method (_m) the columns of its
    support, refutation, ignorance and conflict; grids: of (method, keys, outer) both lists of thresholds, ascending."""
    columns = sorted({c for of in methods.values() for c in of})
    rows = rows.select(*keys, "gold_state", _lists(rows).cast("array<int>").alias("fold"), *(F.col(c).cast("double").alias(c) for c in columns))
    found = sorted({g[1:-1] for g in grids})
    names, outers, sides = _names(rows, keys, found), max(folds, 1), {}
    most = [max((len(x[s]) for x in grids.values()), default=0) + 1 for s in (0, 1)]
    for i, key in enumerate(found):
        for m in methods:
            for s in (0, 1):
                lists = [np.asarray(grids[m, *key, f][s], float) if (m, *key, f) in grids else None for f in range(outers)]
                merged = np.unique(np.concatenate([x for x in lists if x is not None] or [[]]))
                # of each place among the thresholds of all folds, how many of a fold's own lie below
                own = np.stack([np.zeros(len(merged) + 1, np.int64) if x is None else np.r_[0, np.searchsorted(x, merged, "right")] for x in lists])
                sides[i, m, s] = merged, own
    asked = {(i, m): np.array([(m, *key, f) in grids for f in range(outers)]) for i, key in enumerate(found) for m in methods}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_: dict[tuple, np.ndarray] = {}
        own: dict[tuple, np.ndarray] = {}
        for batch in batches:
            g, (at, fold) = _numbers(batch, "_g"), _inside(batch, folds)
            gold, value = batch.column("gold_state").dictionary_encode(null_encoding="encode"), {c: _numbers(batch, c) for c in columns}
            label, kinds = gold.indices.to_numpy(zero_copy_only=False), gold.dictionary.to_pylist()
            toward, reach = {}, {}
            for i in np.unique(g):
                mine = np.flatnonzero(g == i)
                hit = (g == i)[at]
                for m, (support, refute, *cut) in methods.items():
                    if (i, m) not in asked:
                        continue
                    if (support, refute) not in toward:
                        less = value[support] - value[refute]
                        toward[support, refute] = np.where(less > tie, 1, np.where(-less > tie, 2, 0))
                    spots = []
                    for s, c in enumerate(cut):
                        edges = sides[i, m, s][0]
                        known = (c, i, edges.tobytes())
                        if known not in reach:
                            reach[known] = np.where(np.isnan(value[c]), 0, np.searchsorted(edges, value[c], "right"))
                        spots.append(reach[known])
                    direction = toward[support, refute]
                    shape = tuple(len(sides[i, m, s][0]) + 1 for s in (0, 1))
                    for j, state in enumerate(kinds):
                        if (i, m, state) not in all_:
                            all_[i, m, state], own[i, m, state] = np.zeros((3, *shape), np.int64), np.zeros((outers, 3, *most), np.int64)
                        x = mine[label[mine] == j]
                        np.add.at(all_[i, m, state], (direction[x], spots[0][x], spots[1][x]), 1)
                        inside = hit & (label[at] == j)
                        x, f = at[inside], fold[inside]
                        np.add.at(own[i, m, state], (f, direction[x], sides[i, m, 0][1][f, spots[0][x]], sides[i, m, 1][1][f, spots[1][x]]), 1)
        for (i, m, state), n in all_.items():
            whole = np.zeros((outers, 3, *most), np.int64)
            d, t, k = np.nonzero(n)
            for f in range(outers):
                np.add.at(whole[f], (d, sides[i, m, 0][1][f, t], sides[i, m, 1][1][f, k]), n[d, t, k])
            whole[~asked[i, m]] = 0
            f, d, t, k = np.nonzero(whole)
            same, part = len(f), own[i, m, state][f, d, t, k]
            yield pa.record_batch(
                [pa.array([m] * same, pa.string()), pa.array(np.full(same, i, np.int32)), pa.array(f.astype(np.int32)), pa.array([state] * same, pa.string()), pa.array(d.astype(np.int32)), pa.array(t.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(whole[f, d, t, k]), pa.array(part)],
                names=["_m", "_g", "outer", "gold_state", "d", "t", "k", "n", "own"],
            )

    counted = _keyed(rows, keys, names).select("_g", "gold_state", "fold", *columns).mapInArrow(count, "_m string, _g int, outer int, gold_state string, d int, t int, k int, n long, own long")
    sums = counted.groupBy("_m", "_g", "outer", "gold_state", "d", "t", "k").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    direction = F.element_at(F.array(*map(F.lit, DIRECTIONS)), F.col("d") + 1).alias("direction")
    return kept(sums.join(F.broadcast(names), "_g").select("_m", *keys, "outer", "gold_state", direction, "t", "k", "n", "own"), "reached")
