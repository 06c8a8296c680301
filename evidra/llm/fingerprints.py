"""Document fingerprints by Order MinHash.

The k-mers of a text (code points) are numbered by occurrence, so repeats count. Under each of SKETCHES hash functions
the two minimal numbered k-mers are selected, put back into text order, and hashed as a tuple to one component. The
share of equal components estimates a likeness that falls with edit distance, reordering included.

Defined results: a null text counts as empty; the empty text has a fingerprint of its own, with likeness 1 to itself
and 0 to others; a text shorter than k is one k-mer; equal texts have equal fingerprints. Whole texts are read; long
ones in pieces, so memory stays bounded.

with_next() meets each document's successor in descending order of (doc_id, text), nulls last, and the first one after
the last. Documents are dealt out by ranges of ids; the head of each range is also sent to the range above it, so no
task sees more than its range and no window spans the table.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm._shared import map_batches

K = 16
SKETCHES = 64
#: k-mers that are hashed at once.
PIECE = 8192
_U = np.uint32
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, (SKETCHES, 1), dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, (SKETCHES, 1), dtype=np.uint32) | _U(1)
_LANE = _RNG.integers(0, 1 << 32, SKETCHES, dtype=np.uint32)
EMPTY = "0" * (4 * SKETCHES)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(16))) * _U(0x85EBCA6B)
    h = (h ^ (h >> _U(13))) * _U(0xC2B2AE35)
    return h ^ (h >> _U(16))


def kmers(text: str) -> np.ndarray:
    """A hash of each k-mer in order; of the whole text if it is shorter."""
    h = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") + _U(1))
    if len(h) < K:
        h = np.concatenate([h, np.zeros(K - len(h), np.uint32)])
    width, base = 1, 0x01000193
    while width < K:
        h = h[:-width] * _U(base) + h[width:]
        width, base = width * 2, base * base & 0xFFFFFFFF
    return h


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (k-mer, number of its occurrence), and the k-mers' places in the text."""
    key = np.sort(h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64))
    h, place = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    i = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), i, 0))
    return _mix(h ^ ((i - first).astype(np.uint32) * _U(0x9E3779B1))), place


def sketch(text: str) -> np.ndarray:
    """SKETCHES components of 16 bits; None stands for no k-mer at all."""
    c, place = numbered(kmers(text))
    lanes, values, picks = np.arange(SKETCHES), [], []
    for begin in range(0, len(c), PIECE):
        v = (c[None, begin : begin + PIECE] ^ _XOR) * _MUL
        for _ in range(min(2, v.shape[1])):
            least = v.argmin(1)
            values.append(v[lanes, least].copy())
            picks.append(least + begin)
            v[lanes, least] = 0xFFFFFFFF
    if len(picks) > 2:
        by = np.argsort(np.stack(values), axis=0, kind="stable")[:2]
        picks = list(np.take_along_axis(np.stack(picks), by, 0))
    if len(picks) == 2:
        a, b = picks
        swap = place[a] > place[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        tuple_hash = c[a] * _U(0x85EBCA77) + _mix(c[b] + _U(1))
    else:
        tuple_hash = c[picks[0]] * _U(0x85EBCA77)
    return (_mix(tuple_hash ^ _LANE) >> _U(16)).astype(np.uint16)


def fingerprint(text: str | None) -> str:
    """Hexadecimal components of a text."""
    return sketch(text).astype(">u2").tobytes().hex() if text else EMPTY


def likeness(a: str, b: str) -> float:
    """Share of equal components, 0 to 1."""
    if EMPTY in (a, b):
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


def _bucket(column: Column, bounds: list[int], low: int = 0) -> Column:
    """The number of bounds at or below the column, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(column >= bounds[mid], _bucket(column, bounds[mid + 1 :], low + mid + 1)).otherwise(_bucket(column, bounds[:mid], low))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, ghost, doc_id, text), sorted within each partition so that a document is followed by its successor; a
    ghost row is there as a successor only."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else []
    rows = rows.withColumn("bucket", F.coalesce(_bucket(F.col("doc_id"), bounds), F.lit(0)).cast("int"))
    # one row a bucket: the head is the largest id; bucket 0 without ids is led by null
    heads = sorted(map(tuple, rows.groupBy("bucket").agg(F.max("doc_id"), F.count("*")).collect()), reverse=True)
    rows = rows.withColumn("ghost", F.lit(False))
    if not heads:
        return rows.select("bucket", "ghost", "doc_id", "text")
    above = {lower[0]: upper[0] for upper, lower in zip(heads, heads[1:], strict=False)} | {heads[0][0]: heads[-1][0]}
    links = spark.createDataFrame([(head, above[b], b) for b, head, _ in heads], "head long, above int, own int")
    ghosts = rows.join(F.broadcast(links), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("bucket") == F.col("own")))
    ghosts = ghosts.select(F.col("above").alias("bucket"), F.lit(True).alias("ghost"), "doc_id", "text")
    both = rows.select("bucket", "ghost", "doc_id", "text").unionByName(ghosts)
    # bucket k is partition k: hashing the few buckets would put several of them into one task
    return both.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the first as many code points of what follows (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@lru_cache(maxsize=256)
def _cached(text: str) -> str:
    return fingerprint(text)


def _compare(batches):
    held, followed = None, False  # (bucket, doc_id, text, fingerprint), and whether its bucket's successor ghost came
    for batch in batches:
        out = [[] for _ in range(7)]
        for bucket, ghost, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if held and held[0] == bucket and not followed:
                mine, changed = held[3], edited(held[2], text)
                other = fingerprint(changed) if changed != held[2] else mine
                next_print = _cached(text)
                values = (held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mine, other, likeness(mine, other), likeness(mine, next_print))
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            if ghost:
                followed = True
            else:
                held, followed = (bucket, key, text, _cached(text)), False
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see with_next() for the order."""
    return map_batches(with_next(docs), _compare, OUT)


def _prints(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in batch.column(1).to_pylist()])], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of docs (doc_id, text)."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _prints, "doc_id long, fingerprint string")
