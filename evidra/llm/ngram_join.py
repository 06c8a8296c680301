"""Exact Jaccard self-join on word n-grams by token-combination prefixes.

A text's set holds the digests of its word n-grams (tokens). Tokens stand in one order: rare ones first, then frequent
ones by frequency. Each set has a prefix long enough that two sets which link must share a signature in it. A rare token
is a signature by itself; frequent tokens fall into small classes (by hash; their number follows the set's size), and
every pair of tokens of one class is a signature. A class with c tokens in a prefix forces at most one of them to be
shared without a common pair, so it covers c - 1 places; prefixes are extended until they cover one place more than
the tokens that a set may miss in a partner. Sets near a power of two in size take part at two sizes.

Signatures that several sets share give candidates. In small groups all pairs of compatible size are taken once, and a
bitmap that bounds their difference drops most that don't link. Large groups, as of thousands of near copies, are chained
by size, those of about the same number of sets together. Bitmaps are compared in blocks, over a chain or over each of its
groups, whichever is less work, and report a spanning forest of what is close. Close sets that hang together are a neighbourhood; it is cut into blocks of bounded size, each
pair of blocks is verified on the whole sets and reports a spanning forest of its links: no link between components is
lost and no list of all pairs is made. Links become components by star contraction.

Which tokens are frequent only steers the work: any choice gives the same links. It is counted over all texts, and at
most MAX_FREQUENT tokens are broadcast.

Sets are named by 64-bit digests, as are tokens: of n sets two share a name with probability n * n / 2**65. Defined
results: a null or empty text, or one of white space, has an empty set and links with nothing; fewer words than a
shingle are one token, the whole sequence; copies have the same set; rows with a null id take part, but never name a
component; extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm._shared import Memo, dropped, map_batches, released, steps, strings, written
from evidra.llm.components import components

#: A token of at least FREQUENT distinct sets is frequent, if it was in LOCAL sets of those that a task held together.
FREQUENT, LOCAL, MAX_FREQUENT, HELD_TOKENS = 12, 3, 500_000, 3_000_000
#: Sets that share a signature up to which all pairs are taken.
SMALL_GROUP = 24
#: Tokens and sets in a block of a neighbourhood, and tokens behind the bitmaps in a block (a bit for one or two).
BLOCK_TOKENS, BLOCK_SETS, BITMAP_TOKENS = 800_000, 1_000, 16_000_000
#: Ids that are broadcast to select documents (8 bytes each); beyond, the selection is a shuffled join.
MAX_BROADCAST = 1_000_000
#: Bits of the least bitmap, and those compared at once.
LEAST_BITS, STEP_BITS = 1024, 2048
_M = np.uint64(0x9E3779B97F4A7C15)


def new_memo() -> Memo:
    """Of words' digests."""
    return Memo(24 << 20, 160)


def tokens(text: str, width: int, memo: Memo) -> np.ndarray:
    """The sorted distinct digests of a text's n-grams of width words. A-Z count as a-z; words end at ASCII space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    memo.trim()
    digests = list(map(memo.get, words))
    if None in digests:
        for i, w in enumerate(words):
            if digests[i] is None:
                digests[i] = memo[w] = xxhash.xxh3_64_intdigest(w)
    a = np.array(digests, np.uint64)
    n = min(width, len(a))
    if not n:
        return a
    h = np.full(len(a) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h * _M) ^ a[i : len(a) - n + 1 + i]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def set_name(t: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(t.tobytes()) - (1 << 63)


def least_size(percent: int) -> int:
    """Sets with fewer tokens link with equal sets only."""
    return -(-percent // (100 - percent))


def prefix_signatures(t: np.ndarray, percent: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The signatures of a set. frequent: sorted tokens; rank: their frequency class."""
    n = len(t)
    if n < least_size(percent):
        return np.empty(0, np.uint64)
    miss = (100 - percent) * n // 100
    head = t[: 2 * (miss + 1)]
    if len(frequent):
        # mostly the prefix is rare tokens, found without a look at the rest
        head = head[frequent[np.minimum(np.searchsorted(frequent, head), len(frequent) - 1)] != head]
    if len(head) > miss:
        return head[: miss + 1]
    at = np.searchsorted(frequent, t)
    at[at == len(frequent)] = 0
    common = frequent[at] == t if len(frequent) else np.zeros(n, bool)
    if not common[: miss + 1].any() or not common.any():
        if (~common).sum() > miss:
            return t[~common][: miss + 1]
    by = np.lexsort((t, np.where(common, rank[at] if len(frequent) else 0, -1)))
    t, common = t[by], common[by]
    size_class = n.bit_length() - 1
    sizes = [size_class] if n * percent >= 100 << size_class else [size_class, size_class - 1]
    found = []
    for b in sizes:
        classes = max(1, (1 << b) // 8)
        own = np.where(common, ((t >> np.uint64(7)) % np.uint64(classes)).astype(np.int64), -1)
        covers = np.ones(n, np.int64)
        kinds, first = np.unique(own, return_index=True)
        covers[first[kinds >= 0]] = 0
        end = int(np.searchsorted(np.cumsum(covers), miss + 1)) + 1
        head, shared = t[:end], common[:end]
        found.append(head[~shared])
        many, label = head[shared], own[:end][shared]
        by = np.lexsort((many, label))
        many, label = many[by], label[by]
        for step in range(1, len(many)):
            same = label[step:] == label[:-step]
            if not same.any():
                break
            found.append((many[:-step][same] * _M) ^ (many[step:][same] * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.unique(np.concatenate(found))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def bitmap(t: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens that fall on each bit; two sets differ in a token at least for each bit that
    their bitmaps differ in. Its length is a power of two, half the set's size or more; halves can be folded by XOR."""
    bits = max(LEAST_BITS, 1 << (max(len(t) - 1, 0) // 2).bit_length())
    odd = np.bincount(((t >> np.uint64(17)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows), at the length of so many words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _sets(width: int):
    """Rows (kind 0: doc_id, its set's name, size and bitmap; kind 1: a token and the number of sets with it, of those
    held together)."""

    columns = ["kind", "id", "name", "n", "bitmap"]

    def run(batches):
        memo, seen, held = new_memo(), {}, 0

        def counted():
            if seen:
                token, n = np.unique(np.concatenate(list(seen.values())), return_counts=True)
                token, n = token[n >= LOCAL], n[n >= LOCAL]
                k = len(token)
                yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array(_signed(token)), pa.array([0] * k, pa.int64()), pa.array(n, pa.int64()), pa.nulls(k, pa.list_(pa.int64()))], columns)
                seen.clear()

        for batch in batches:
            for part in steps(batch):
                names, sizes, maps = [], [], []
                for text in strings(part.column(1)):
                    t = tokens(text, width, memo)
                    name = set_name(t)
                    names.append(name)
                    sizes.append(len(t))
                    maps.append(bitmap(t))
                    if name not in seen and len(t):
                        seen[name] = t
                        held += len(t)
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(names), pa.int32()), part.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.list_(pa.int64()))], columns)
                if held > HELD_TOKENS:
                    yield from counted()
                    held = 0
        yield from counted()

    return run


def _signatures(width: int, percent: int, shared):
    def run(batches):
        frequent, rank = shared.value
        memo = new_memo()
        done = set()  # sets of this task, so that copies are named once in it
        for batch in batches:
            for part in steps(batch):
                sigs, names, sizes = [], [], []
                for text in strings(part.column(0)):
                    t = tokens(text, width, memo)
                    name = set_name(t)
                    if name in done:
                        continue
                    if len(done) > 300_000:
                        done.clear()
                    done.add(name)
                    s = prefix_signatures(t, percent, frequent, rank)
                    sigs.append(s)
                    names.append(np.full(len(s), name))
                    sizes.append(np.full(len(s), len(t)))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sigs))), pa.array(np.concatenate(names), pa.int64()), pa.array(np.concatenate(sizes), pa.int64())], ["sig", "name", "n"])

    return run


def _tokens(width: int):
    """(root, block, name, tokens); a row whose id has another text of that name is left out."""

    def run(batches):
        memo = new_memo()
        for batch in batches:
            for part in steps(batch):
                sets = [tokens(text, width, memo) for text in strings(part.column(3))]
                own = [set_name(t) == name for t, name in zip(sets, part.column(2).to_pylist(), strict=True)]
                kept = part.filter(pa.array(own, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array([_signed(t) for t, k in zip(sets, own, strict=True) if k], pa.list_(pa.int64()))], ["root", "block", "name", "tokens"])

    return run


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph of a symmetric boolean matrix, by breadth-first search over its rows."""
    n, found = len(linked), []
    free = np.ones(n, bool)
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        queue = [start]
        for u in queue:
            new = np.nonzero(linked[u] & free)[0]
            free[new] = False
            found.extend((u, v) for v in new.tolist())
            queue.extend(new.tolist())
    return found


def close_bitmaps(maps: list[np.ndarray], sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and bitmaps allow a link. Bits that differ are counted by products."""
    n, words = len(maps), np.array([len(m) for m in maps])
    close = np.zeros((n, n), bool)
    classes = np.unique(words)
    for k, few in enumerate(classes):
        x = np.nonzero(words == few)[0]
        for many in classes[k:]:
            y = np.nonzero(words == many)[0]
            if sizes[x].max() * 100 < percent * sizes[y].min():
                continue
            left = np.stack([maps[i] for i in x])
            right = folded(np.stack([maps[i] for i in y]), few)
            agree = np.zeros((len(x), len(y)), np.float32)
            for begin in range(0, few, STEP_BITS // 64):
                p, q = (np.unpackbits(np.ascontiguousarray(m[:, begin : begin + STEP_BITS // 64]).view(np.uint8), axis=1).astype(np.float32) * 2 - 1 for m in (left, right))
                agree += p @ q.T
            differ = (few * 64 - agree) / 2
            na, nb = sizes[x][:, None], sizes[y][None, :]
            least = -(-(na + nb) * percent // (100 + percent))
            near = (differ <= na + nb - 2 * least) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            close[np.ix_(x, y)] = near
            close[np.ix_(y, x)] = near.T
    np.fill_diagonal(close, False)
    return spanning_forest(close)


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets. Overlaps are counted for all pairs by products of token columns."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[code] > 1
    code, owner = np.unique(code[keep], return_inverse=True)[1], owner[keep]
    overlap = np.zeros((n, n), np.float32)
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    width = min(max(256, 4_000_000 // max(n, 1)), int(code[-1]) + 1 if len(code) else 1)
    for begin in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [begin, begin + width])
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], code[a:b] - begin] = 1
        overlap += part @ part.T
    total = sizes[:, None] + sizes[None, :]
    linked = 100 * overlap >= percent * (total - overlap)
    np.fill_diagonal(linked, False)
    return spanning_forest(linked)


#: Sets that a task holds as it drops links that others of it imply.
FOREST_SETS = 500_000


def _forest(batches):
    """Of a task's links (name, last) those that join what wasn't joined by those before: the same groups by fewer links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    for batch in batches:
        keep = []
        for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))
        if len(root) > FOREST_SETS:
            root.clear()


def _named(names: pd.Series, found: list[tuple[int, int]]) -> pd.DataFrame:
    names = names.to_numpy()
    return pd.DataFrame({"a": names[[i for i, _ in found]].astype(np.int64), "b": names[[j for _, j in found]].astype(np.int64)})


def _block(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _named(pdf["name"], block_links([np.asarray(t) for t in pdf["tokens"]], percent))

    return run


def _bitmap_block(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _named(pdf["name"], close_bitmaps([np.asarray(m) for m in pdf["bitmap"]], pdf["n"].to_numpy(), percent))

    return run


def _compatible(small: Column, large: Column, percent: int) -> Column:
    return small * 100 >= large * percent


def _differ(few: Column, many: Column) -> Column:
    """The bits that two bitmaps differ in. many may be twice as long; for other lengths, as occur below 50 percent, 0."""
    half = F.size(many) / 2
    fold = F.zip_with(F.slice(many, 1, half.cast("int")), F.slice(many, half.cast("int") + 1, half.cast("int")), lambda p, q: p.bitwiseXOR(q))
    fitted = F.when(F.size(few) == F.size(many), many).when(F.size(few) == half, fold).otherwise(few)
    return F.aggregate(F.zip_with(few, fitted, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _in_blocks(members: DataFrame, most_tokens: int) -> DataFrame:
    """members (root, name, n, ..) with a block: sets of a root in order of size, cut by tokens and number."""
    running = Window.partitionBy("root").orderBy("n", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return members.withColumn("block", F.floor(F.greatest(F.sum("n").over(running) / most_tokens, F.count("*").over(running) / BLOCK_SETS)))


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """(root, i, j, block): each pair i <= j of a root's blocks whose sizes allow a link, once for either block."""
    blocks = members.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = blocks.select("root", F.col("block").alias("i"), F.col("high")), blocks.select("root", F.col("block").alias("j"), F.col("low"))
    cells = left.join(right, "root").filter((F.col("i") == F.col("j")) | ((F.col("i") < F.col("j")) & _compatible(F.col("high"), F.col("low"), percent))).select("root", "i", "j")
    cells = cells.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    return F.broadcast(cells) if cells.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else cells


def _level(size: Column) -> Column:
    """Groups of about the same size: near copies share signatures of one level or two, what else a set is in has others."""
    return F.floor(F.log2(size / SMALL_GROUP) / 2)


def _chained(large: DataFrame, percent: int) -> DataFrame:
    """Links (node, last) that join the sets of each large group (sig, node, n) which sizes allow to hang together. Sizes
    fall into classes, each as wide as a link allows: sets of one may link, and so do classes next to each other if the
    largest set of one and the least of the other may. A class is a star around its least node: most of the groups that
    near copies share have the same one, so that their links are few."""
    wide = math.log(100 / percent) * (1 + 1e-9)  # a little more than a link allows, as logarithms are rounded
    classed = large.withColumn("class", F.floor(F.log("n") / wide))
    star = classed.withColumn("last", F.min("node").over(Window.partitionBy("sig", "class"))).select("node", "last")
    order = Window.partitionBy("sig").orderBy("class")
    heads = classed.groupBy("sig", "class").agg(F.min("node").alias("node"), F.min("n").alias("low"), F.max("n").alias("high"))
    heads = heads.withColumns({"last": F.lag("node").over(order), "last_high": F.lag("high").over(order)})
    heads = heads.filter(_compatible(F.col("last_high"), F.col("low"), percent)).select("node", "last")
    links = star.filter("node <> last").unionByName(heads).distinct()
    return map_batches(links, _forest, "name long, last long").withColumnRenamed("name", "node")


def _compared(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, name, n): sets that are compared with each other, of large groups (sig, node, name, n) with the roots of their
    chains. In a table that grows, chance groups chain nearly all sets; near copies share many groups. So a chain is compared
    as a whole if that takes fewer pairs than its groups do, one by one, and else each of its groups is."""
    held = large.join(roots, "node").select("root", "sig", "name", "n")
    square = lambda c: F.col(c).cast("double") * F.col(c)
    apart = held.groupBy("root", "sig").agg(F.count("*").alias("k")).groupBy("root").agg(F.sum(square("k")).alias("apart"))
    whole = roots.groupBy("root").agg(F.count("*").alias("k")).withColumn("whole", square("k"))
    split = written(apart.join(whole, "root").filter("apart < whole").select("root", F.lit(True).alias("split")), "split")
    few = split.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    held = held.join(F.broadcast(split) if few else split, "root", "left").withColumn("root", F.when(F.col("split"), F.xxhash64("root", "sig")).otherwise(F.col("root")))
    return held.select("root", "name", "n").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text): texts link when percent (50 to 99) or more of the union
    of their sets of n-grams of width words is shared; component_id is the least id that links reach."""
    if not 50 <= percent <= 99 or width < 1:
        raise ValueError("percent has to be within 50 and 99, and width at least 1")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(map_batches(rows, _sets(width), "kind int, id long, name long, n long, bitmap array<long>"), "sets")
    documents = sets.filter("kind = 0").select(F.col("id").alias("doc_id"), "name", "n")
    common = sets.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "id").limit(MAX_FREQUENT).toArrow()
    frequent, times = common.column("id").to_numpy().view(np.uint64), common.column("n").to_numpy()
    by = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[by], np.log2(times[by]).astype(np.int64)))

    signatures = map_batches(rows.select("text"), _signatures(width, percent, shared), "sig long, name long, n long")
    group = Window.partitionBy("sig")
    met = signatures.repartition("sig").dropDuplicates(["sig", "name"]).withColumn("size", F.count("*").over(group)).filter("size > 1")
    met = written(met, "signatures")
    del signatures
    released(spark)

    # small groups: each pair once
    small = met.filter(F.col("size") <= SMALL_GROUP)
    x, y = small.select("sig", F.col("name").alias("a"), F.col("n").alias("na")), small.select("sig", F.col("name").alias("b"), F.col("n").alias("nb"))
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = x.join(y, "sig").filter(order & _compatible(F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb").distinct()
    pairs = written(pairs, "pairs")

    large = met.filter(F.col("size") > SMALL_GROUP).withColumn("node", F.xxhash64(_level(F.col("size")), "name"))
    # a bitmap bounds the difference of a pair: |a| + |b| - 2i tokens at most, with i the least overlap that links
    bitmaps = sets.filter("kind = 0").select("name", "bitmap")
    maps = bitmaps.join(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct(), "name", "left_semi").groupBy("name").agg(F.first("bitmap").alias("bitmap"))
    # a table of its own: Spark can then split the joins on a set that is in very many pairs
    maps = written(maps, "maps")
    least = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    close = pairs.join(maps.select(F.col("name").alias("a"), F.col("bitmap").alias("ma")), "a").join(maps.select(F.col("name").alias("b"), F.col("bitmap").alias("mb")), "b")
    close = written(close.filter(_differ(F.col("ma"), F.col("mb")) <= F.col("na") + F.col("nb") - 2 * least).select("a", "b"), "close")

    # large groups: their bitmaps meet in blocks, each pair of blocks reports a spanning forest of close pairs
    holders = documents.filter("n > 0").groupBy("name", "n").agg(F.min("doc_id").alias("doc_id"))
    roots = components(_chained(large, percent), "node", "last", "chains")
    chains = written(_in_blocks(_compared(large, roots), BITMAP_TOKENS), "chain-members")
    dropped(roots)
    own = bitmaps.join(chains.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.first("bitmap").alias("bitmap"))
    placed = chains.join(own, "name").join(_cells(chains, percent), ["root", "block"]).select("root", "i", "j", "name", "n", "bitmap")
    near = written(placed.groupBy("root", "i", "j").applyInPandas(_bitmap_block(percent), "a long, b long"), "near")
    del placed
    released(spark)

    # what may link is gathered in neighbourhoods, and these are cut into blocks by size
    roots = components(close.unionByName(near), "a", "b", "hoods")
    members = written(_in_blocks(roots.select(F.col("node").alias("name"), "root").join(holders, "name"), BLOCK_TOKENS), "members")
    dropped(roots)
    cells = _cells(members, percent)

    # each set goes once to every cell of its block; a cell reports a spanning forest of its links
    few = members.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    held = members.select("root", "block", "name", F.col("doc_id").alias("holder"))
    placed = rows.join(F.broadcast(held) if few else held, rows["doc_id"].eqNullSafe(F.col("holder"))).select("root", "block", "name", "text")
    placed = map_batches(placed, _tokens(width), "root long, block long, name long, tokens array<long>")
    placed = placed.join(cells, ["root", "block"]).select("root", "i", "j", "name", "tokens")
    links = written(placed.groupBy("root", "i", "j").applyInPandas(_block(percent), "a long, b long"), "links")
    del placed
    dropped(pairs, maps, close, chains, near, members, met)
    released(spark)

    joined = components(links, "a", "b", "components")
    first = documents.groupBy("name").agg(F.min("doc_id").alias("first"))
    # the least id of each component of several sets
    several = joined.join(first, F.col("node") == F.col("name")).groupBy("root").agg(F.min("first").alias("least"))
    several = joined.join(several, "root").select(F.col("node").alias("name"), "least")
    named = first.join(several, "name", "left").select("name", F.coalesce("least", "first").alias("component_id"))
    named = written(named, "named")
    dropped(links, joined)
    return documents.join(named, "name").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that stay if each component of groups (near_duplicates() of docs) keeps its least id. Rows with
    a null id stay if their component has no id; of rows that repeat an id and its text one stays."""
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    plain = groups.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1).count() == 0
    if plain:
        ids = gone.select("doc_id").distinct()
        few = ids.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_anti")
    # an id stands for several rows: those whose component it names stay, equal ones once
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    order = Window.partitionBy("doc_id", "text").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"])
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    return rows.withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row")
