"""Whitening of embeddings by a covariance in two passes.

Components become integers. The fit list has each distinct integer vector once. A first pass takes exact sums of integers,
and so the mean as a quotient of integers; a second one centres each vector by it and adds up outer products, a batch at
a time, by a matrix product. Both give one partial result a task, and treeAggregate merges these on the executors, so the
driver gets a few matrices of dimensions x dimensions, however many tasks there are. LAPACK's symmetric solver gives the
eigenvectors; those of the largest eigenvalues, over the root of these, are the projection, which is broadcast
(dimensions x components numbers). A third pass over the fit list measures how far the whitened covariance is from the
identity, centred block by block.

Defined results: rows whose vector is null or has null or non-finite components are left out, as are those of another
length than most distinct vectors have; repeated rows are fitted once and come back each; rows with a null id come back;
further columns are ignored by fit() and kept by transform(); components whose eigenvalue is 0 but for rounding are left
out, so equal vectors alone, one vector or an empty table give no component. A component beyond 2**52 after scaling,
and a deviation beyond 64 bits, are errors.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm._shared import dropped, quoted, written
from evidra.llm.vectors import block, most_common_size, scaled, usable

SCALE, SHIFT = 64, 1_000_000
#: An eigenvalue below this share of the largest is 0 but for rounding.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S; the projection (dimensions, components), its eigenvalues' shares of the trace, and
    the largest entry of the whitened covariance less the identity."""

    n: int
    sums: tuple[int, ...]
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float
    scale: int = SCALE
    shift: int = SHIFT


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x less the mean: the whole part is taken off exactly, as integers."""
    whole, rest = zip(*(divmod(s, n) for s in sums), strict=True)
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array(rest, np.float64) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The sum over dimensions of (n * x - S) ** 2, exactly."""
    whole, rest = zip(*(divmod(s, n) for s in sums), strict=True)
    off = x - np.array(whole, np.int64)
    most = n * (int(np.abs(off).max(initial=0)) + 1)
    if most * most * len(sums) >= 2**63:
        off = off.astype(object)
    d = off * n - np.array(rest, off.dtype)
    total = (d * d).sum(1) if len(x) else np.empty(0, np.int64)
    if off.dtype == object and max(total, default=0) >= 2**63:
        raise OverflowError(f"the deviation from the mean of {n} vectors doesn't fit 64 bits")
    return total.astype(np.int64)


def added_up(rows: DataFrame, size: int, start, add: Callable, merge: Callable):
    """add(part, block) over the blocks of each task of rows (x) from start(), and merge(part, part) over tasks, on the
    executors. start, add and merge are small functions of NumPy."""

    def run(batches):
        part = start()
        for batch in batches:
            if len(batch):
                part = add(part, block(batch.column(0), size))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part)], pa.binary())], ["part"])

    parts = rows.select("x").mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(bytes(r["part"])))
    return parts.treeAggregate(start(), merge, merge, 2 if parts.getNumPartitions() < 10_000 else 3)


def _spread(a, b):
    """(n, mean, sum of centred outer products) of two parts together."""
    (n, mean, outer), (m, other, more) = a, b
    if not n or not m:
        return b if m else a
    off = other - mean
    return n + m, mean + off * (m / (n + m)), outer + more + np.outer(off, off) * (n * m / (n + m))


def _solved(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection and explained shares from a covariance. Signs are such that a vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = np.argsort(-values, kind="stable")[:components]
    order = [i for i in order if values[i] > LEAST_SHARE * max(values[-1], 0)]
    chosen = vectors[:, order]
    if len(order):
        chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(0), range(len(order))])
    return chosen / np.sqrt(values[order]), values[order] / trace if len(order) else np.empty(0)


def fit(vectors: DataFrame, components: int = 16, scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """The whitening of vectors (embedding) onto their first components."""
    rows = vectors.select("embedding").filter(usable(F.col("embedding"))).select(scaled(F.col("embedding"), scale, shift).alias("x"))
    found = written(rows.distinct(), "fit-list")
    size = most_common_size(found, "x")
    rows = found.filter(F.size("x") == size)
    if not size:
        dropped(found)
        return Whitening(0, (), np.empty((0, 0)), np.empty(0), 0.0, scale, shift)

    # whole numbers of a batch, added to Python's unbounded ones in two halves
    def add(part, x):
        low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
        return part[0] + len(x), [s + int(a) + (int(b) << 32) for s, a, b in zip(part[1], low, high, strict=True)]

    n, sums = added_up(rows, size, lambda: (0, [0] * size), add, lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1], strict=True)]))

    def outer(part, x):
        c = centred(x, n, sums)
        return part + c.T @ c

    covariance = added_up(rows, size, lambda: np.zeros((size, size)), outer, lambda a, b: a + b) / n
    projection, explained = _solved(covariance, components)
    k = projection.shape[1]

    def white(part, x):
        w = centred(x, n, sums) @ projection
        mean = w.mean(0)
        return _spread(part, (len(w), mean, (w - mean).T @ (w - mean)))

    _, _, whitened = added_up(rows, size, lambda: (0, np.zeros(k), np.zeros((k, k))), white, _spread)
    error = float(np.abs(whitened / n - np.eye(k)).max(initial=0))
    dropped(found)
    return Whitening(n, tuple(sums), projection, explained, error, scale, shift)


def transform(vectors: DataFrame, model: Whitening, keep: list[str]) -> DataFrame:
    """The columns keep of the usable rows of vectors (embedding), with deviation long and whitened array<double>."""
    names = [c for c in keep if c not in ("deviation", "whitened")]
    size, sent = len(model.sums), vectors.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(quoted(c)) for c in names]
    rows = vectors.filter(usable(F.col("embedding"))).select(*kept, scaled(F.col("embedding"), model.scale, model.shift).alias("_x")).filter(F.size("_x") == size)

    def run(batches):
        m = sent.value
        for batch in batches:
            if not len(batch) or not size:
                continue
            x = block(batch.column(len(names)), size)
            w = centred(x, m.n, m.sums) @ m.projection
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(deviations(x, m.n, m.sums)), white], [*names, "deviation", "whitened"])

    fields = [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema][: len(names)]
    return rows.mapInArrow(run, ", ".join([*fields, "deviation long", "whitened array<double>"]))
