"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

Features are the presence of hashed words, of the heads (first letters) of long words, of word pairs and of pairs with
one word between them. FTRL-proximal has a rate for each coordinate and an L1 term that leaves most weights at exactly
0, so the trained model is a short list of indices and weights, small enough to broadcast (its size is checked). Scores are
calibrated on rows that the model which scores them hasn't learned from, so they are probabilities and a threshold means the
same for any table.

Fitting takes at most max_fit labelled rows, those with the lowest hash of their id, in that order, in one task: a
bounded sample that does not depend on the partitioning. Defined results: null and empty texts have no feature and get
the score of the bias; ids with labels that disagree, and null labels, are not learned from; of rows that repeat a
labelled id the least text is learned; repeated rows get equal scores; without a label to learn from every score is 0.
Whole texts are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm._shared import Memo, map_batches, steps, strings, with_columns

WORDS = re.compile(r"[^\W\d_]+")
BITS = 20
SIZE = 1 << BITS
#: Most weights that are broadcast: 12 bytes each.
MAX_WEIGHTS = 500_000


class Words:
    """Hashes of the words that a task has met: of the word and of its heads (0: the word is no longer than that)."""

    HEADS = (5, 6, 7, 8)

    def __init__(self):
        self.place = Memo(24 << 20, 220)
        self.hashes = np.empty((0, 1 + len(self.HEADS)), np.uint64)

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """The hashes of each word of each text, in a row."""
        self.place.trim()
        place, known = self.place, len(self.place)
        try:
            at = [place[w] for words in texts for w in words]
        except KeyError:
            new = {w for words in texts for w in words if w not in place}
            place.update(zip(new, range(known, known + len(new)), strict=True))
            of = lambda x: crc32(x.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            rows = [[of(w), *(of("~" + w[:n]) if len(w) > n else 0 for n in self.HEADS)] for w in new]
            self.hashes = np.concatenate([self.hashes[:known], np.array(rows, np.uint64)])
            at = [place[w] for words in texts for w in words]
        return self.hashes[np.array(at, np.int64)]


def features(texts: list[str], hashes: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in a row, and each text's first one (with a last border)."""
    words = [WORDS.findall(text.lower()) for text in texts]
    found, begin, parts, sizes = hashes(words), 0, [], []
    for n in map(len, words):
        h, heads = np.ascontiguousarray(found[begin : begin + n, 0]), found[begin : begin + n, 1:].ravel()
        begin += n
        each = [h, h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:], h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] * np.uint64(3), heads[heads != 0]]
        parts += [(x >> np.uint64(64 - BITS)).astype(np.int32) for x in each]
        sizes.append(sum(map(len, each)))
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(SIZE, np.float32)
        w[self.index] = self.weight
        return w


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 15.0, l2: float = 1.0, epochs: int = 5) -> ToxicityModel:
    """FTRL-proximal over rows of distinct feature indices. The bias is a coordinate of its own without L1. The rarer class
    weighs more, by the root of the classes' ratio."""
    share = np.clip(labels.mean(), 0.001, 0.999)
    weight = np.maximum(1, np.sqrt([share / (1 - share), (1 - share) / share]))
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    lasso = np.full(SIZE + 1, l1)
    lasso[SIZE] = 0

    def weights(i):
        return np.where(np.abs(z[i]) <= lasso[i], 0, -(z[i] - np.sign(z[i]) * lasso[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            i = np.append(row, SIZE)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * weight[int(y)]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(SIZE + 1))
    hit = np.flatnonzero(w[:SIZE])
    return ToxicityModel(float(w[SIZE]), hit, w[hit].astype(np.float32))


def platt(logits: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """The scale and offset of logits under which they are probabilities of the labels (Newton's method; the scale is held
    near 1 by a weak prior, and both classes by half a row each)."""
    s = np.append(logits, [0.0, 0.0])
    y, w = np.append(labels, [0.0, 1.0]), np.append(np.ones(len(labels)), [0.5, 0.5])
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -35, 35)))
        g, h = (p - y) * w, np.maximum(p * (1 - p) * w, 1e-9)
        slope = np.array([(g * s).sum() + (a - 1), g.sum()])
        step = np.linalg.solve(np.array([[(h * s * s).sum() + 1, (h * s).sum()], [(h * s).sum(), h.sum()]]), slope)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def trained(rows: list[np.ndarray], labels: np.ndarray, parts: int = 3, **settings) -> ToxicityModel:
    """A calibrated model: each part of the rows is scored by a model of the others, and what turns these scores into
    probabilities is applied to the model of all rows. A feature of one row alone says nothing about others and is left out."""

    def of(rows: list[np.ndarray], labels: np.ndarray) -> ToxicityModel:
        times = np.bincount(np.concatenate(rows), minlength=SIZE)
        return ftrl([r[times[r] > 1] for r in rows], labels, **settings)

    model, part = of(rows, labels), np.arange(len(rows)) % parts
    if len(rows) < 2 * parts or labels.min() == labels.max():
        return model
    logits = np.zeros(len(rows))
    for k in range(parts):
        inside, rest = np.flatnonzero(part == k), np.flatnonzero(part != k)
        m = of([rows[i] for i in rest], labels[rest])
        dense = m.dense().astype(np.float64)
        logits[inside] = [m.bias + dense[rows[i]].sum() for i in inside]
    a, b = platt(logits, labels)
    return ToxicityModel(float(a * model.bias + b), model.index, (a * model.weight).astype(np.float32))


def _rows(batches):
    hashes = Words()
    for whole in batches:
        for batch in steps(whole):
            ids, cuts = features(strings(batch.column(2)), hashes)
            packed = [np.unique(ids[a:b]).astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["place", "label", "features"])


def _train(batches):
    labels, rows = [], []
    for batch in batches:
        labels += batch.column(1).to_pylist()
        rows += [np.frombuffer(x, "<i4").astype(np.int64) for x in batch.column(2).to_pylist()]
    if labels:
        m = trained(rows, np.array(labels, float))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(m.index, -1), pa.int32()), pa.array(np.append(m.weight, m.bias), pa.float64())], ["i", "w"])


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): one row for each id whose non-null labels agree."""
    rows = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("_max")).filter("label = _max").select("doc_id", "label")


def sample_of(docs: DataFrame, labels: DataFrame, column: str, learn: Column, max_fit: int) -> DataFrame:
    """(place, label, text): at most max_fit rows, of the ids for which learn holds with the lowest hashes. Of rows that repeat
    an id the least text is taken, before the shuffle."""
    chosen = labelled(labels, column).filter(learn).withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_fit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "place", "label").agg(F.min("text").alias("text")).select("place", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, column: str = "toxic", max_fit: int = 12_000) -> ToxicityModel:
    """A model from the labelled rows for which learn (of doc_id) holds."""
    rows = map_batches(sample_of(docs, labels, column, learn, max_fit), _rows, "place long, label int, features binary")
    # only the sample's features meet in one task; coalesce(1) would draw the scan of all documents into it
    found = map_batches(rows.repartition(1).sortWithinPartitions("place", "features"), _train, "i int, w double").toArrow()
    index, weight = found.column("i").to_numpy(), found.column("w").to_numpy()
    if len(index) > MAX_WEIGHTS:
        raise ValueError(f"{len(index)} weights are too many to broadcast; raise l1")
    if not len(index):
        return ToxicityModel(-35.0, np.empty(0, np.int64), np.empty(0, np.float32))
    return ToxicityModel(float(weight[-1]), index[:-1].astype(np.int64), weight[:-1].astype(np.float32))


def _scorer(model: ToxicityModel):
    def at(text: int, keep: int):
        def run(batches):
            dense, hashes = model.dense(), Words()
            for whole in batches:
                for batch in steps(whole, text):
                    ids, cuts = features(strings(batch.column(text)), hashes)
                    hit = np.flatnonzero(dense[ids])
                    # a feature counts once in a text
                    owner = np.searchsorted(cuts, hit, side="right") - 1
                    key = np.unique(owner * SIZE + ids[hit])
                    total = model.bias + np.bincount(key // SIZE, dense[key % SIZE], len(batch))
                    score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(score, pa.float64())], [*batch.schema.names[:keep], "score"])

        return run

    return at


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all unless told) with the score (0 to 1) of each text."""
    return with_columns(docs, {"score": "double"}, _scorer(model), keep)
