"""Exact top-k over binary codes by incremental multi-index hashing.

A code is cut into 16-bit segments. The index has each distinct code once for each segment, in the bucket of the segment's
first bits; buckets are cells that lie over the cluster. A query searches all segments within a radius that grows: it
goes to the cells whose first bits are within the radius of its own, where codes are verified whose segment is. Within
radius r every code within m * (r + 1) - 1 bits has been met (m segments); a query whose kth verified distance is no
larger is proven and done, and only the others go on to the next radius. A code that several segments reach is
reported by the first of them alone. The rounds are joined by tables in the shared folder.

Equal codes are collapsed first: of each code only the k smallest ids can be in a result, so a very common vector costs
one entry. A bucket with many codes is split by hash into cells of CELL_CODES or so, and one with many queries is dealt to
several tasks, so neither needs more memory. Ties are broken by id.

Defined results: null vectors, vectors of the wrong length and null ids are neither indexed nor asked; NaN and null
components are 0 bits; repeated ids with equal codes count once, with other codes once each; an empty table gives no rows;
a query finds itself at distance 0; where there are less than k ids, all are found. Further columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm._shared import dropped, map_batches, released, written

SEGMENT_BITS = 16
#: Codes of a bucket that make it worth a split by one bit more; codes and queries of a cell.
BUCKET_CODES, CELL_CODES, CELL_QUERIES = 1_024, 8_192, 8_192
#: Bits of a segment that name a bucket, at most (the whole segment): the list of buckets is broadcast, 65,536 rows a segment.
MOST_BITS = 16
#: The radius of the first round; each further one is greater by one.
FIRST_RADIUS = 2


def _coder(bits: int):
    def run(batches):
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            rows = np.flatnonzero((vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == bits) & ids.is_valid().to_numpy(zero_copy_only=False))
            kept = vectors.take(pa.array(rows))
            sign = np.nan_to_num(kept.flatten().to_numpy(zero_copy_only=False)).reshape(-1, bits) > 0
            codes = [c.tobytes() for c in np.packbits(sign, axis=1, bitorder="little")]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(codes, pa.binary())], ["vec_id", "code"])

    return run


def sign_codes(vectors: DataFrame, bits: int = 64) -> DataFrame:
    """(vec_id, code): one bit for each positive component; bits is a multiple of 16."""
    return map_batches(vectors.select(F.col("vec_id").cast("long"), "embedding"), _coder(bits), "vec_id long, code binary")


def _smallest(k: int):
    """The k smallest distinct ids of each code, in two steps, so that a very common code is cut down where it lies."""
    by = Window.partitionBy("code", "part").orderBy("vec_id")
    again = Window.partitionBy("code").orderBy("vec_id")

    def run(codes: DataFrame) -> DataFrame:
        part = codes.distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
        part = part.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k)
        part = part.withColumn("n", F.row_number().over(again)).filter(F.col("n") <= k)
        return part.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    return run


def _segments(df: DataFrame, m: int, bits: int) -> DataFrame:
    """Rows of df (code) for each of its m segments, with the bucket: the segment's first bits."""
    value = lambda s: F.conv(F.hex(F.substring("code", 2 * s + 1, 2)), 16, 10).cast("int")
    each = F.array(*(F.shiftright(value(s), SEGMENT_BITS - bits) for s in range(m)))
    return df.select("*", F.posexplode(each).alias("segment", "bucket"))


def nearest_in_cell(codes: np.ndarray, ids: list, queries: np.ndarray, bounds: np.ndarray, segment: int, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k best that each query meets in this segment first, at a radius of low to high. codes
    and queries: rows of 16-bit segments; ids: those of each code; bounds: distances beyond which nothing is wanted."""
    step, found = max(1, 4_000_000 // max(len(codes), 1)), []
    for begin in range(0, len(queries), step):
        part = queries[begin : begin + step]
        q, c = np.nonzero(np.bitwise_count(part[:, None, segment] ^ codes[None, :, segment]) <= high)
        radii = np.bitwise_count(part[q] ^ codes[c])
        distance = radii.sum(1, dtype=np.int64)
        # met before at a smaller radius, or by an earlier segment in this round
        new = (radii.min(1) >= low) & (radii[:, :segment] > high).all(1) & (distance <= bounds[begin + q])
        q, c, distance = q[new] + begin, c[new], distance[new]
        own = np.array([len(i) for i in ids], np.int64)[c] if len(c) else np.empty(0, np.int64)
        flat = np.concatenate([ids[i] for i in c]).astype(np.int64) if len(c) else np.empty(0, np.int64)
        q, distance = np.repeat(q, own), np.repeat(distance, own)
        by = np.lexsort((flat, distance, q))
        q, flat, distance = q[by], flat[by], distance[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        found.append((q[place < k], flat[place < k], distance[place < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _flips(bits: int, least: int, most: int) -> list[int]:
    """The numbers of so many bits with least to most ones."""
    return [sum(1 << b for b in ones) for r in range(max(least, 0), min(most, bits) + 1) for ones in combinations(range(bits), r)]


def _cell(k: int, low: int, high: int):
    def run(key, codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(queries):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "code": [], "vec_id": np.empty(0, np.int64), "distance": np.empty(0, np.int64)})
        table, asked = (np.frombuffer(b"".join(df["code"]), "<u2").reshape(len(df), -1) for df in (codes, queries))
        q, ids, distance = nearest_in_cell(table, list(codes["ids"]), asked, queries["bound"].to_numpy(), int(key[0]), low, high, k)
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[q], "code": queries["code"].to_numpy()[q], "vec_id": ids, "distance": distance})

    return run


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance): for each query (query_id, code) its k nearest of codes (vec_id, code)."""
    result = "query_id long, rank long, vec_id long, distance long"
    spark, distinct = codes.sparkSession, written(_smallest(k)(codes), "codes")
    n, n_ids, m = distinct.agg(F.count("*"), F.sum(F.size("ids")), F.max(F.length("code")) / 2).first()
    if not n:
        dropped(distinct)
        return spark.createDataFrame([], result)
    m, wanted = int(m), min(k, n_ids)
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(n / BUCKET_CODES))))
    index = _segments(distinct, m, bits)
    # at most m * 2 ** MOST_BITS rows
    buckets = written(index.groupBy("segment", "bucket").agg(F.ceil(F.count("*") / CELL_CODES).cast("int").alias("cells")), "buckets")
    active = written(queries.select("query_id", "code").distinct().withColumn("bound", F.lit(SEGMENT_BITS * m)), "active")
    best, low, high = None, 0, FIRST_RADIUS
    key = ["segment", "bucket", "cell", "deal"]
    while True:
        # a segment at a distance of low to high has a bucket at most so far away, and at least that less the bits it lacks
        flips = F.split(F.lit(",".join(map(str, _flips(bits, low - (SEGMENT_BITS - bits), high)))), ",").cast("array<int>")
        probes = _segments(active, m, bits).withColumn("flip", F.explode(flips)).withColumn("bucket", F.col("bucket").bitwiseXOR(F.col("flip"))).drop("flip")
        met = probes.groupBy("segment", "bucket").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("deals"))
        known = F.broadcast(buckets.join(F.broadcast(met), ["segment", "bucket"]))
        to = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        left = index.join(known, ["segment", "bucket"]).withColumn("cell", to("code", "cells")).withColumn("deal", every("deals")).select(*key, "code", "ids")
        right = probes.join(known, ["segment", "bucket"]).withColumn("deal", to("query_id", "deals")).withColumn("cell", every("cells")).select(*key, "query_id", "code", "bound")
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_cell(k, low, high), "query_id long, code binary, vec_id long, distance long")
        order = Window.partitionBy("query_id", "code").orderBy("distance", "vec_id")
        merged = (best.unionByName(found) if best else found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
        last, best = best, written(merged, "best")
        covered = m * (high + 1) - 1
        reached = best.groupBy("query_id", "code").agg(F.count("*").alias("found"), F.max("distance").alias("kth"))
        left_over = active.join(reached, ["query_id", "code"], "left").filter((F.coalesce("found", F.lit(0)) < wanted) | (F.col("kth") > covered))
        waiting = written(left_over.select("query_id", "code", F.when(F.col("found") >= wanted, F.col("kth")).otherwise(SEGMENT_BITS * m).cast("int").alias("bound")), "active")
        dropped(active, *([last] if last else []))
        active = waiting
        released(spark)
        if high == SEGMENT_BITS or active.isEmpty():
            break
        low, high = high + 1, high + 1
    dropped(distinct, buckets, active)
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", F.col("rank").cast("long"), "vec_id", "distance")
