"""Hard negatives for anchors, by dense products of blocks.

Anchors are dealt to chunks of bounded size; a chunk's vectors are broadcast. Each task multiplies blocks of anchors with
blocks of the candidates that lie with it, in float64, and keeps of each anchor the best candidates of its own label; these
lists are merged by anchor. The scores of an anchor's positives set windows for its negatives, and a second pass over the
candidates keeps the best of other labels within each window, merged in the same way. What a task holds does not grow
with the candidates: one list of a fixed length for each anchor of the chunk (and window). All anchors meet all candidates:
the work is the product of their numbers, as it is asked for.

Scores are inner products of whole numbers. Where a chunk's and a block's norms show that a float64 may not hold every
partial sum (2**53), the product is taken in 64-bit integers; where these may not do either, that is an error.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part, nor do those
of another length than most vectors have; rows that repeat an id with equal score count once, with another vector or label as
candidates of their own, but never as partners of their own id; ties go to the smaller id; anchors without a positive,
and positives without a negative, have no row; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm._shared import dropped, grouped, written
from evidra.llm.vectors import block, most_common_size, scaled, usable

#: Anchors of a chunk, and numbers in their vectors, at most; anchors and candidates of a block.
CHUNK, CHUNK_NUMBERS, ANCHORS, CANDIDATES = 16_384, 4_000_000, 512, 4_096
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_NONE = np.iinfo(np.int64).min


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a, b) inner products of whole numbers, exact: float64 where that can hold every partial sum, else 64-bit integers."""
    bound = float(np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0)) * np.sqrt((b.astype(np.float64) ** 2).sum(1).max(initial=0)))
    if bound < 2**53 * 0.999:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    if bound < 2**63 * 0.999:
        return a @ b.T
    raise OverflowError("inner products don't fit 64 bits")


class Best:
    """The k best (score, then smaller id) of each of many lists; equal pairs count once."""

    def __init__(self, lists: int, k: int):
        self.score, self.id = np.full((lists, k), _NONE), np.full((lists, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        """A score below this can't enter a list."""
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        k = self.score.shape[1]
        touched = np.unique(at)
        old, slot = np.nonzero(self.score[touched] != _NONE)
        at = np.concatenate([at, touched[old]])
        score, ids = np.concatenate([score, self.score[touched][old, slot]]), np.concatenate([ids, self.id[touched][old, slot]])
        by = np.lexsort((ids, -score, at))
        at, score, ids = at[by], score[by], ids[by]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        at, score, ids = at[new], score[new], ids[new]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < k
        self.score[at[first], place[first]], self.id[at[first], place[first]] = score[first], ids[first]

    def rows(self) -> pa.RecordBatch:
        at, slot = np.nonzero(self.score != _NONE)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(self.score[at, slot]), pa.array(self.id[at, slot])], ["list", "score", "id"])


def _blocks(batches, size: int):
    """(ids, labels, vectors) of Arrow batches (id, label, x), a block at a time."""
    for batch in grouped((b for b in batches if len(b)), CANDIDATES, 64 << 20):
        for begin in range(0, len(batch), CANDIDATES):
            part = batch.slice(begin, CANDIDATES)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), block(part.column(2), size)


def _positives(shared, size: int, k: int):
    def run(batches):
        ids, labels, x = shared.value
        best = Best(len(ids), k)
        of = {v: np.flatnonzero(labels == v) for v in np.unique(labels).tolist()}
        for c_ids, c_labels, c in _blocks(batches, size):
            for label in np.intersect1d(c_labels, labels).tolist():
                same = np.flatnonzero(c_labels == label)
                for begin in range(0, len(of[label]), ANCHORS):
                    a = of[label][begin : begin + ANCHORS]
                    s = products(x[a], c[same])
                    p, q = np.nonzero((s >= best.least[a][:, None]) & (ids[a][:, None] != c_ids[same][None, :]))
                    best.add(a[p], s[p, q].astype(np.int64), c_ids[same][q])
        yield best.rows()

    return run


def _negatives(shared, windows, size: int, k: int):
    """As _positives(), with a list for each window. windows: each one's anchor (its place, ascending) and bounds."""

    def run(batches):
        ids, labels, x = shared.value
        owner, low, high = windows.value
        best = Best(len(owner), k)
        for c_ids, c_labels, c in _blocks(batches, size):
            for begin in range(0, len(ids), ANCHORS):
                first, end = np.searchsorted(owner, [begin, begin + ANCHORS])
                if first == end:
                    continue
                s = products(x[begin : begin + ANCHORS], c)
                other = labels[begin : begin + ANCHORS][:, None] != c_labels[None, :]
                least = np.maximum(low[first:end], best.least[first:end])
                # the windows of one rank at a time: each anchor has one at most
                nth = np.arange(first, end) - np.searchsorted(owner, owner[first:end])
                for rank in range(int(nth.max()) + 1):
                    w = np.flatnonzero(nth == rank)
                    mine = owner[first + w] - begin
                    own = s[mine]
                    p, q = np.nonzero((own >= least[w][:, None]) & (own <= high[first + w][:, None]) & other[mine])
                    best.add(first + w[p], own[p, q].astype(np.int64), c_ids[q])
        yield best.rows()

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(list, rank, score, id): the k best of each list over all tasks."""
    by = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, scale: int = 256, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding). Anchors
    are those for which anchor (of vec_id) holds; positives: how many of the same label; negatives: how many of other labels
    for each of them, whose score is within window percent of its own."""
    spark = rows.sparkSession
    clean = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    clean = clean.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    size = most_common_size(clean, "embedding")
    if not size:
        return spark.createDataFrame([], RESULT)
    clean = clean.filter(F.size("embedding") == size).select("vec_id", "label", scaled(F.col("embedding"), scale).alias("x"))
    anchors = written(clean.filter(anchor).distinct().withColumn("place", F.monotonically_increasing_id()), "anchors")
    chunks = -(-anchors.count() // max(1, min(CHUNK, CHUNK_NUMBERS // size)))
    made = []
    for chunk in range(chunks):
        # rows follow one another in place, so the chunks are of a size but for one row a file
        a = anchors.filter(F.pmod("place", F.lit(chunks)) == chunk).select("vec_id", "label", "x").orderBy("vec_id", "label").toArrow().combine_chunks()
        ids, labels, x = a.column(0).to_numpy(), a.column(1).to_numpy(), block(a.column(2).combine_chunks(), size)
        shared = spark.sparkContext.broadcast((ids, labels, x))
        near = _merged(clean.mapInArrow(_positives(shared, size, positives), "list long, score long, id long"), positives).orderBy("list", "rank").toArrow()
        owner, score = near.column("list").to_numpy(), near.column("score").to_numpy()
        p_ids, bound = near.column("id").to_numpy(), lambda f: np.array([f(int(s)) for s in score], np.int64)
        low, high = bound(lambda s: -(-window[0] * s // 100)), bound(lambda s: window[1] * s // 100)  # noqa: B023
        windows = spark.sparkContext.broadcast((owner, low, high))
        found = _merged(clean.mapInArrow(_negatives(shared, windows, size, negatives), "list long, score long, id long"), negatives)
        named = spark.createDataFrame(pa.table({"list": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": p_ids, "positive_score": score}))
        out = found.join(F.broadcast(named), "list").select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        made.append(written(out, "hard-negatives"))
        shared.unpersist()
        windows.unpersist()
    dropped(anchors)
    return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], RESULT)
