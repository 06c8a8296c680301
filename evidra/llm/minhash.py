"""Near duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

A text's set holds the digests of its word n-grams. One permutation, the order of the digests, serves all BINS bins: the
range of digests is cut into bins and each keeps its least digest. An empty bin takes the value of a bin that holds one,
the first in an order of all bins that is its own and the same for all sets (optimal densification). ROWS bins make a
band, and sets that agree in a band share a bucket: at a similarity of 0.85 two sets share none of the 48 bands with a
probability of about 1e-10, at 0.8 of 5e-7.

A bucket's sets aren't paired: the least name is its centre, and a star joins the others to it. What is close to the centre
by bitmaps is verified on the full sets. With t the similarity of a link, sets that link with their centre are done.
Sets of a similarity below 2 t - 1 can't link with any of those (1 - similarity is a metric), and go on to the next
round with a centre of their own. Those between may link with some that the centre links, so they share a
neighbourhood with it, and go on as well. After ROUNDS rounds what is left in a bucket is a neighbourhood. Neighbourhoods
are cut into blocks of bounded size; pairs of blocks are compared by bitmaps, then on full sets, and report spanning forests
of their links. So no link between sets that share a bucket is lost, a bucket of n sets takes at most n candidates a
round, and no list of all pairs is made. Links become components by star contraction.

Sets are named by 64-bit digests, as are n-grams (see ngram_join, whose digests, bitmaps and blocks these are). Defined
results: a null or empty text, or one of white space, has an empty set and links with nothing; fewer words than a shingle
are one n-gram, the whole sequence; sets with less tokens than one miss allows link with equal sets only; copies have the
same set; rows with a null id take part, but never name a component, and are kept if it has none; an empty table gives no
rows; extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import ngram_join
from evidra.llm._shared import dropped, map_batches, released, steps, strings, written
from evidra.llm.components import components
from evidra.llm.ngram_join import BITMAP_TOKENS, MAX_BROADCAST, bitmap, least_size, new_memo, set_name, tokens

BANDS, ROWS, ROUNDS = 48, 6, 3
BINS = BANDS * ROWS
_EDGES = np.array([(i << 64) // BINS for i in range(BINS)], np.uint64)
#: The place of each bin in the order in which an empty bin (row) looks for one that isn't.
_ORDER = np.random.default_rng(11).permuted(np.tile(np.arange(BINS, dtype=np.uint16), (BINS, 1)), axis=1)
_M = np.uint64(0x9E3779B97F4A7C15)


def sketch(t: np.ndarray) -> np.ndarray:
    """The least digest of each bin of a set that isn't empty (sorted digests); empty bins are filled."""
    first = np.searchsorted(t, _EDGES)
    full = np.diff(first, append=len(t)) > 0
    out = np.empty(BINS, np.uint64)
    out[full] = t[first[full]]
    if not full.all():
        held, lacking = np.flatnonzero(full), np.flatnonzero(~full)
        out[lacking] = out[held[_ORDER[lacking[:, None], held].argmin(1)]]
    return out


def bands(t: np.ndarray) -> np.ndarray:
    """The buckets of a set: a digest of each band's number and values."""
    s = sketch(t).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = (h * _M) ^ s[:, i]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _sketches(width: int, percent: int):
    """(id, name, n, buckets): the buckets come once for each set of a task, and for sets that can link with others."""

    def run(batches):
        memo, done = new_memo(), set()
        for batch in batches:
            for part in steps(batch):
                names, sizes, keys = [], [], []
                for text in strings(part.column(1)):
                    t = tokens(text, width, memo)
                    name = set_name(t)
                    names.append(name)
                    sizes.append(len(t))
                    new = len(t) >= least_size(percent) and name not in done
                    keys.append(bands(t) if new else None)
                    if new:
                        if len(done) > 300_000:
                            done.clear()
                        done.add(name)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "name", "n", "buckets"])

    return run


def _full_sets(width: int):
    """(name, n, bitmap, tokens); a row whose id has another text of that name is left out."""

    def run(batches):
        memo = new_memo()
        for batch in batches:
            for part in steps(batch, 1):
                names, found = [], []
                for name, text in zip(part.column(0).to_pylist(), strings(part.column(1)), strict=True):
                    t = tokens(text, width, memo)
                    if set_name(t) == name:
                        names.append(name)
                        found.append(t)
                arrays = [pa.array(names, pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array(list(map(bitmap, found)), pa.list_(pa.int64())), pa.array([t.view(np.int64) for t in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["name", "n", "bitmap", "tokens"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most MAX_BROADCAST rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def _judged(pairs: DataFrame, sets: DataFrame, percent: int, near: int) -> DataFrame:
    """(a, b, links) of the pairs whose similarity is near or more: by size, by bitmaps, and then on full sets."""
    of = lambda x, *more: sets.select(F.col("name").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in more))
    sized = pairs.join(of("a", "n", "bitmap"), "a").join(of("b", "n", "bitmap"), "b")
    # the shorter bitmap first
    swap = F.col("n_a") > F.col("n_b")
    either = lambda c, first: F.when(swap == first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    total = F.col("n_a") + F.col("n_b")
    least = F.ceil(total * near / (100 + near))
    alike = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * near) & (ngram_join._differ(either("bitmap", True), either("bitmap", False)) <= total - 2 * least)
    close = sized.filter(alike).select("a", "b")
    both = close.join(of("a", "n", "tokens"), "a").join(of("b", "n", "tokens"), "b")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    counted = both.select("a", "b", (100 * shared).alias("shared"), (F.col("n_a") + F.col("n_b") - shared).alias("all"))
    return counted.filter(F.col("shared") >= near * F.col("all")).select("a", "b", (F.col("shared") >= percent * F.col("all")).alias("links"))


def _in_blocks(members: DataFrame, most_tokens: int) -> DataFrame:
    """members (root, name, n) with a block: sets of a root are dealt by hash within classes of similar size, to as many
    blocks as the class's tokens and sets need. The counts are combined before the shuffle; no task sees a whole root."""
    by = members.withColumn("_class", F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(1.1))).cast("long"))
    parts = F.ceil(F.greatest(F.sum("n") / most_tokens, F.count("*") / ngram_join.BLOCK_SETS)).cast("long")
    held = written(by.groupBy("root", "_class").agg(parts.alias("_parts")), "blocks")
    block = F.col("_class") * (1 << 32) + F.pmod(F.xxhash64("name"), F.col("_parts"))
    out = written(by.join(_few(held), ["root", "_class"]).withColumn("block", block).drop("_class", "_parts"), "members")
    dropped(held)
    return out


def _in_neighbourhoods(hoods: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning forests of the links among the sets of each neighbourhood (name, root)."""
    sizes = sets.select("name", "n")
    members = _in_blocks(hoods.join(sizes, "name"), BITMAP_TOKENS)
    placed = members.join(sets.select("name", "bitmap"), "name").join(ngram_join._cells(members, percent), ["root", "block"])
    near = written(placed.select("root", "i", "j", "name", "n", "bitmap").groupBy("root", "i", "j").applyInPandas(ngram_join._bitmap_block(percent), "a long, b long"), "hood-near")
    roots = components(near, "a", "b", "hoods").select(F.col("node").alias("name"), "root")
    close = _in_blocks(roots.join(sizes, "name"), ngram_join.BLOCK_TOKENS)
    placed = close.join(sets.select("name", "tokens"), "name").join(ngram_join._cells(close, percent), ["root", "block"])
    links = written(placed.select("root", "i", "j", "name", "tokens").groupBy("root", "i", "j").applyInPandas(ngram_join._block(percent), "a long, b long"), "hood-links")
    dropped(members, near, close)
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of docs (doc_id, text): texts link when percent (75 to 99) or more of the
    union of their sets of n-grams of width words is shared; component_id is the least id that links reach, and the
    document of that id is kept."""
    if not 75 <= percent <= 99 or width < 1:
        raise ValueError("percent has to be within 75 and 99, and width at least 1")
    spark, near = docs.sparkSession, 2 * percent - 100
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(map_batches(rows, _sketches(width, percent), "id long, name long, n long, buckets array<long>"), "sketches")
    documents = sketches.select(F.col("id").alias("doc_id"), "name", "n")

    # buckets of several sets; counts and centres are combined before the shuffle
    each = sketches.filter("buckets IS NOT NULL").select(F.explode("buckets").alias("bucket"), "name").distinct()
    # (a table of its own: then Spark can split the join on a bucket that very many sets share)
    def with_centres(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("bucket").agg(F.min("name").alias("centre"), F.count("*").alias("sets")).filter("sets > 1")
        centres = written(found.select("bucket", "centre"), "centres")
        out = written(rows.join(centres, "bucket"), "spokes")
        dropped(centres)
        return out

    spokes = with_centres(each)
    # the full sets of those that met another one, read once
    met = spokes.select("name").distinct()
    holders = documents.join(met, "name", "left_semi").groupBy("name").agg(F.min("doc_id").alias("holder"))
    holders = _few(written(holders, "holders"))
    texts = rows.join(holders, rows["doc_id"].eqNullSafe(F.col("holder"))).select("name", "text")
    sets = map_batches(texts, _full_sets(width), "name long, n long, bitmap array<long>, tokens array<long>")
    sets = written(sets.dropDuplicates(["name"]), "full-sets")

    judged: list[DataFrame] = []
    made = [sketches, spokes, sets]
    for _ in range(ROUNDS):
        star = spokes.filter(F.col("centre") != F.col("name")).select(F.col("centre").alias("a"), F.col("name").alias("b")).distinct()
        for known in judged:
            star = star.join(known, ["a", "b"], "left_anti")
        judged.append(written(_judged(star, sets, percent, near), "judged"))
        linked = reduce(DataFrame.unionByName, judged).filter("links").select(F.col("a").alias("centre"), F.col("b").alias("name"))
        left = spokes.filter(F.col("centre") != F.col("name")).join(linked, ["centre", "name"], "left_anti").select("bucket", "name")
        spokes = with_centres(left)
        made.append(spokes)
        if spokes.isEmpty():
            break
    pairs = reduce(DataFrame.unionByName, judged)
    links = pairs.filter("links").select("a", "b")
    # what may hide a link: sets near to a centre, and what the rounds have left
    open_ = pairs.filter("NOT links").select("a", "b").unionByName(spokes.filter(F.col("centre") != F.col("name")).select(F.col("centre").alias("a"), F.col("name").alias("b")))
    open_ = written(open_.distinct(), "open")
    if not open_.isEmpty():
        whole = components(links.unionByName(open_), "a", "b", "hoods")
        roots = whole.join(open_.join(whole, F.col("a") == F.col("node")).select("root").distinct(), "root", "left_semi")
        inside = _in_neighbourhoods(roots.select(F.col("node").alias("name"), "root"), sets, percent)
        made.append(inside)
        links = links.unionByName(inside)
    joined = components(links, "a", "b", "components")
    first = documents.groupBy("name").agg(F.min("doc_id").alias("first"))
    # the least id of each component of several sets
    by_set = joined.join(first, F.col("node") == F.col("name")).select("name", "root", "first")
    least = by_set.join(by_set.groupBy("root").agg(F.min("first").alias("least")), "root").select("name", "least")
    named = written(first.join(least, "name", "left").select("name", F.coalesce("least", "first").alias("component_id")), "named")
    out = written(documents, "documents")
    dropped(*made, *judged, open_, joined)
    released(spark)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.join(named, "name").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
