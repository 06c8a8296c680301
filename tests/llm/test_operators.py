"""Each operator against a plain version, and on nulls, empty and odd tables."""

import base64
import hashlib
import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from evidra.llm import bpe, chat, components, fingerprints, language_id, ngram_join, packing, quality, sharding, topk, toxicity
from evidra.llm._shared import id_hash_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n\t"), (4, "x" * 5000), (5, "Ünï ©ode 漢字 \0 end"), (5, "Ünï ©ode 漢字 \0 end"), (7, "one two three"), (8, "ONE two three"), (9, "½ 12 %%")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).withColumn("score", F.lit("x")).withColumn("name", F.lit(1))


def prose(seed, n=200, words=None):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) if words and rng.random() < 0.7 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_fingerprints(spark):
    assert fingerprints.likeness(fingerprints.fingerprint(None), fingerprints.fingerprint("")) == 1.0
    long = prose(1, 6000)
    assert fingerprints.fingerprint(long) == fingerprints.fingerprint(long + "")
    head = long[: len(long) // 2]
    assert fingerprints.likeness(fingerprints.fingerprint(long), fingerprints.fingerprint(long[:-5] + "other")) > 0.8
    # order counts: the same halves swapped are less alike than an untouched text
    assert fingerprints.likeness(fingerprints.fingerprint(long), fingerprints.fingerprint(long[len(head) :] + head)) < 0.9
    out = fingerprints.compare_with_edited(docs(spark, ODD)).collect()
    order = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0)))
    ids = [i for i, _ in order]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i in ids)
    by = {r.doc_id: r for r in out}
    text = dict(ODD)
    expected = fingerprints.edited(text[9], text[8])
    assert by[9].edited_sha256 == hashlib.sha256(expected.encode()).hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256(fingerprints.edited(text[None], text[9]).encode()).hexdigest()
    assert by[1].edited_sha256 == hashlib.sha256(b"").hexdigest() and fingerprints.compare_with_edited(docs(spark, [])).count() == 0


def test_quality_and_toxicity(spark):
    rows = [(i, prose(i, 60) + (" vile rotten" if i % 4 == 0 else "")) for i in range(240)] + [(i, ("%% " + prose(i, 50).replace(" ", "%%% ")) if i % 3 == 0 else prose(i, 50)) for i in range(240, 400)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, int("%%" not in (t or "")), int("vile" in (t or ""))) for i, t in rows if t] + [(1, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    q = {r.doc_id: r.score for r in quality.score(d, quality.fit(d, labels, id_hash_mod("doc_id", 5) != 0), ["doc_id"]).collect()}
    held = [i for i, t in rows if t and crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(q[i] >= 0.3) == ("%%" not in dict(rows)[i]) for i in held]) > 0.9 and len(q) == len(rows)
    x = {r.doc_id: r.score for r in toxicity.score(d, toxicity.fit(d, labels, id_hash_mod("doc_id", 4) != 2), ["doc_id"]).collect()}
    held = [i for i, t in rows if t and crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(x[i] >= 0.3) == ("vile" in dict(rows)[i]) for i in held]) > 0.9 and x[1000] == x[1001]
    none = labels.limit(0)
    assert quality.score(d, quality.fit(d, none, F.lit(True)), ["doc_id"]).select("score").distinct().count() == 1
    assert toxicity.score(d.limit(0), toxicity.fit(d, none, F.lit(True)), ["doc_id"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_top_k(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(300, 64))
    v[50:120] = v[7]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (None, v[0].tolist()), (501, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    codes = topk.sign_codes(df)
    got = topk.hamming_top_k(codes, codes.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10).collect()
    bits = v > 0
    for q in range(0, 300, 20):
        want = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(300))[:10]
        assert [(r.distance, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    if seed:
        return
    assert topk.hamming_top_k(codes.limit(0), codes.limit(0).withColumnRenamed("vec_id", "query_id")).count() == 0
    few = topk.hamming_top_k(codes.filter("vec_id < 3").withColumn("ids", F.lit(1)), codes.filter("vec_id = 20").select(F.col("vec_id").alias("query_id"), "code", F.lit(1).alias("bound")), 10).collect()
    assert sorted((r.distance, r.vec_id) for r in few) == sorted((int((bits[20] != bits[i]).sum()), i) for i in range(3))


@pytest.mark.parametrize("bucket_codes", [40, 0.005])
def test_top_k_in_split_buckets(spark, monkeypatch, bucket_codes):
    """Buckets of four bits, and of whole segments, of which a round visits those at its own radius alone."""
    assert topk._flips(3, -2, 1) == [0, 1, 2, 4] and sorted(topk._flips(4, 2, 2)) == [3, 5, 6, 9, 10, 12] and len(topk._flips(16, 0, 3)) == 697
    for name, value in (("BUCKET_CODES", bucket_codes), ("CELL_CODES", 30), ("CELL_QUERIES", 7)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 32))
    v[:150, :16] = v[0, :16]
    codes = topk.sign_codes(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), 32)
    got, bits = topk.hamming_top_k(codes, codes.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), 4).collect(), v > 0
    by: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    assert by == {q: sorted((int((bits[q] != bits[i]).sum()), i) for i in range(400))[:4] for q in range(0, 400, 5)}


def test_chat(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for s in ("\\### Assistant: </turn> ok", "\\\\</turn>", "### User: ### User: ", "a\\b", ">: ### <", ""):
        assert chat.unescape(chat.escape(s)) == s
    turns = [(1, 0, "user", "hi </turn>"), (1, 1, "assistant", "\\### Assistant: yes"), (1, 1, "assistant", "\\### Assistant: yes"), (2, None, None, None), (3, 0, "tool>: ", "x"), (None, 0, "assistant", "é漢")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df, path), path).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (3, 2 * len("\\### Assistant: yes"))
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns[:3]).encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[3].turns_sha256 == hashlib.sha256(b"tool>: \nx\n").hexdigest() and got[None].loss_chars == 2


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*ODD, *((100 + i, prose(i, 30 + 40 * (i % 37))) for i in range(60)), (999, prose(5, 9000))]
    out = packing.pack(docs(spark, rows), path).collect()
    enc = packing.tokenizer(path)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    for i, t in rows:
        ids = packing.tokens(t or "", enc).tolist()
        assert ids == plain.encode(t or "", add_special_tokens=False).ids + [1]
    assert sum(r.length for r in out) == sum(len(packing.tokens(t or "", enc)) for _, t in rows)
    pieces = sorted((r for r in out if r.doc_id == 999), key=lambda r: r.start)
    assert [x for r in pieces for x in r.ids] == packing.tokens(dict(rows)[999], enc).tolist()
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 2048 or end & (end - 1) == 0
    assert packing.pack(docs(spark, []), path).count() == 0


def test_sharding(spark, tmp_path):
    df = docs(spark, [(i, prose(i, 20)) for i in range(200)] + ODD)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=200_000)
    for k in range(6):
        store.append(df.filter(F.coalesce(F.col("doc_id") % 6, F.lit(0)) == k).coalesce(1))
    assert store.version() == 6 and len(store.runs()) == 6
    store.compact()
    assert len(store.runs()) < 6 and store.read(6).count() == df.count()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))
    assert store.vacuum() > 0 and store.read().count() == df.count() and store.vacuum() == 0


def test_sharding_of_new_columns_and_empty_arrivals(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError, match="no run"):
        store.read()
    for k in range(4):
        store.append(spark.range(k, k + 1).withColumn("_arrival", F.lit("mine")))
        store.append(spark.range(10 + k, 11 + k).withColumn("extra", F.lit(k)).coalesce(1))
    store.append(spark.range(0).withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError, match="extra"):
        store.append(spark.range(1).withColumn("extra", F.lit("text")))
    assert store.version() == 9 and store.read().filter("extra IS NOT NULL").count() == 4
    store.compact()
    store.vacuum()
    rows = sorted((r.id, r._arrival, r.extra) for r in store.read().collect())
    assert rows == [(k, "mine", None) for k in range(4)] + [(10 + k, None, k) for k in range(4)] and len(store.runs()) < 4
    own = sharding.ShardStore(spark, f"file://{tmp_path}/own")
    own.append_each(spark.range(9).select("id", (F.col("id") + 1).alias("arrival"), F.lit(None).cast("string").alias("Arrival_")), F.col("id") % 3)
    assert own.version() == 3 and {(r.id, r.arrival) for r in own.read().collect()} == {(i, i + 1) for i in range(9)}


def test_sharding_with_other_writers(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/store"
    one, two = sharding.ShardStore(spark, at), sharding.ShardStore(spark, at)
    # both have seen version 0 as they commit: the second finds the name taken and takes the next
    seen = iter([0, 0])
    monkeypatch.setattr(two, "version", lambda: next(seen, 1))
    assert one.append(spark.range(1)) == 1
    assert two.append(spark.range(1, 2)) == 2
    assert sorted(r.id for r in one.read().collect()) == [0, 1]
    # what is written but not yet committed outlives a vacuum, unless it is old
    three = sharding.ShardStore(spark, at)
    run = three._write(spark.range(2, 3), three._new_schema(spark.range(1)))
    assert one.vacuum() == 0
    assert three._commit(run, []) == 3 and one.read().count() == 3
    lost = three._write(spark.range(9), three._new_schema(spark.range(1)))
    assert one.vacuum(orphan_seconds=-60) == 1 and not (tmp_path / "store" / lost[0].run).exists()
    # two merges of the same runs: one is told
    runs = one.runs()
    three._commit([], runs[:1])
    with pytest.raises(RuntimeError):
        one._commit([], runs)
    # beyond a whole list the manifests before it aren't needed
    for k in range(sharding.CHECKPOINT):
        one._commit([], [])
    (tmp_path / "store" / "manifests" / "v00000001.json").unlink()
    assert one.read().count() == 2


def test_sharding_splits_large_shards(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=4000)
    store.append(docs(spark, [(i, prose(i, 60)) for i in range(120)]).coalesce(1))
    assert store.runs()[0].files == 1
    store.compact()
    assert store.runs()[0].files > 3 and store.read().count() == 120 and store.version() == 2


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*ODD, (20, "ab" * 3000 + "é" * 300), (21, "a  b \n c\n \nd "), (22, " \0x \0 y"), (23, "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(1500))), (24, prose(3, 500))]
    for r in bpe.digests(docs(spark, rows), path).collect():
        for t in [t or "" for i, t in rows if i == r.doc_id]:
            ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    whole = bpe.decode(bpe.encode(docs(spark, rows), path, F.col("doc_id")), path, F.col("doc_id")).filter("doc_id = 24").first()
    assert bytes(whole.decoded).decode() == dict(rows)[24]


def test_bpe_of_very_long_words():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, engine = random.Random(1), bpe.Engine(path)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), "ab" * 70_001, "z" * 40_003, "".join(rng.choice("aab") for _ in range(9999)), "=" * 5001 + "-" * 333]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(20_000)), "the" * 3000 + "ing" * 500]
    for t, ids in zip(texts, engine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
    # short words too take the way of long ones, cut every few bytes
    for n in (2, 3, 7):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 40))).encode() for _ in range(60)]
        assert [x.tolist() for x in engine.contract_long(words, n)] == [x.tolist() for x in engine.contract(words)]


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(sets[i]), least.get(root(i))) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("width", "percent", "small", "frequent"), [(4, 85, 24, 12), (5, 80, 3, 2), (2, 70, 2, 2)])
def test_ngram_join(spark, monkeypatch, width, percent, small, frequent):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "LOCAL", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(ngram_join, "BITMAP_TOKENS", 700)
    rng, rows = random.Random(width), [r for r in ODD if r[0] not in (5, 4)]
    for g in range(8):
        base = prose(g, rng.randint(6, 150)).split()
        for k in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(5)}"
            rows.append((1000 + 100 * g + k, " ".join(w[: len(w) - rng.randint(0, 3)])))
    shared = prose(77, 40)
    rows += [(5000 + i, prose(900 + i, 60) + " " + shared) for i in range(15)]
    got = ngram_join.near_duplicates(docs(spark, rows), width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, width, percent)


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_bitmaps_lose_no_link(spark, percent):
    rng = np.random.default_rng(percent)
    sets = []
    for n in (1, 6, 40, 700, 2040, 2060, 4090, 4200):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(4):
            # partners near the bound, larger and smaller
            lost = rng.permutation(n)[: int(n * rng.uniform(0, 0.2))]
            sets.append(np.unique(np.concatenate([np.delete(base, lost), rng.integers(0, 2**63, int(n * rng.uniform(0, 0.08))).astype(np.uint64)])))
        sets.append(np.unique(base))
    sets = [s for s in sets if len(s)]
    maps, sizes = [ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets])

    def parts(edges):
        root = list(range(len(sets)))
        for a, b in edges:
            root = [root[b] if r == root[a] else r for r in root]
        return root

    links = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                links.append((i, j))
    found = ngram_join.close_bitmaps(maps, sizes, percent)
    root = parts(found)
    assert len(links) > 20 and all(root[i] == root[j] for i, j in links) and len(found) == len(sets) - len(set(root))
    exact = parts(ngram_join.block_links(sets, percent))
    assert all((exact[i] == exact[j]) == (parts(links)[i] == parts(links)[j]) for i in range(0, len(sets), 3) for j in range(len(sets)))
    # the same bound in Spark's expressions
    of = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if sizes[i] <= sizes[j] <= 2 * sizes[i]]
    df = spark.createDataFrame([(i, j, maps[i].tolist(), maps[j].tolist()) for i, j in of], "i int, j int, x array<long>, y array<long>")
    for r in df.select("i", "j", ngram_join._differ(F.col("x"), F.col("y")).alias("d")).collect():
        few = len(maps[r.i])
        assert r.d == sum(int(v).bit_count() for v in (maps[r.i] ^ ngram_join.folded(maps[r.j][None], few)[0]).view(np.uint64))


def test_forests_keep_groups(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    links = [(rng.randrange(60) * 3, rng.randrange(60) * 3) for _ in range(400)] + [(500, 501)]
    cut = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in part]), pa.array([b for _, b in part])], ["name", "last"]) for part in (links[:150], links[150:])]

    def groups(edges):
        root = {x: x for e in links for x in e}
        for a, b in edges:
            root = {x: root[b] if r == root[a] else r for x, r in root.items()}
        return {frozenset(x for x in root if root[x] == r) for r in root.values()}

    for most in (500_000, 5):
        monkeypatch.setattr(ngram_join, "FOREST_SETS", most)
        kept = [e for b in ngram_join._forest(cut) for e in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert groups(kept) == groups(links) and len(kept) < (80 if most > 5 else 160)


def test_representatives(spark):
    d = docs(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words entirely here now"), (3, "other words entirely here now"), (4, None), (None, "")])
    kept = ngram_join.representatives(d.select("doc_id", "text"), ngram_join.near_duplicates(d)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 50), (50, 10)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in [*range(31), 50, 200]} | {100: 100, 101: 100}


def test_language_id(spark):
    en, de = "the of and to with that this is for on by".split(), "der die und nicht das mit auf von sich für dem".split()
    rows = [(i, prose(i, 80, en), "en") for i in range(40)] + [(100 + i, prose(i, 80, de), "de") for i in range(40)] + [(200 + i, "привет мир " * 9, "ru") for i in range(10)]
    train = spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train, F.lit(True))
    assert model.languages == ("de", "en", "ru")
    odd = [(1, None), (2, "12 % ½"), (3, prose(7, 80, en) + ". " + prose(8, 80, de)), (4, "мир"), (5, "漢字"), (6, prose(9, 300, de))]
    got = {r.doc_id: r for r in language_id.label_spans(docs(spark, odd), model, ["doc_id"]).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[1].score) == ("und", "und", 0.0)
    assert (got[4].lang_pred, got[6].lang_pred) == ("ru", "de") and got[5].lang_pred in model.languages
    assert [s.lang for s in got[3].spans] == ["en", "de"] and abs(got[3].spans[0].end - 80) <= 8
    empty = language_id.fit(train.limit(0), F.lit(True))
    assert language_id.label_spans(docs(spark, odd), empty, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(6, 3)).astype(np.float32)
    from itertools import product

    def value(path):
        return sum(scores[i, k] for i, k in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    got = language_id.viterbi(scores, np.array([0, 4]), np.array([4, 2]), 0.7)
    assert value(tuple(got[:4])) == pytest.approx(max(map(value, product(range(3), repeat=4))), abs=1e-5)


def test_pipeline_stages_keep_their_contract(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(i, 60), "en") for i in range(60)] + [(100, prose(0, 60), "en"), (101, None, None), (102, "12 %", "en"), (103, prose(3, 60) + " vile", "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "packing"]
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert not ids & {100, 101, 102}


def test_quality_counts_the_most_frequent_word_of_all():
    from evidra.llm import quality

    top = quality.FEATURES.index("top_word")
    words = [f"w{i}" for i in range(800)]
    words[1:100:2] = ["again"] * 50
    found = quality.describe([" ".join(words), " ".join(["first", *words])])[:, top]
    assert found.tolist() == [50 / 800, 50 / 801]


def test_packing_asks_until_the_window_is_full():
    import numpy as np

    from evidra.llm import packing

    # two subjects in turn, in pieces so short that a window holds 64 of them and no closing id is shared
    rng = np.random.default_rng(1)
    docs = [np.append(rng.permutation(40)[:31] + 100 + 1000 * (d % 2), 5000 + d).astype(np.uint32) for d in range(256)]
    pieces = packing.pack_shard(docs)
    held = {}
    for d, _, length, sequence, _ in pieces:
        held.setdefault(sequence, set()).add(d % 2)
    assert sum(p[2] for p in pieces) == 256 * 32 and len(held) == 4
    assert all(len(subjects) == 1 for subjects in held.values())
    # more than 16 rarest terms, all of them spent: the piece that shares only a common term goes before the next row
    common = [np.append(np.arange(20) + 10, 7), np.append(np.arange(20) + 10, 60), *(np.array([100 + d, 200]) for d in range(30)), np.array([7, 90]), np.array([7, 91])]
    index = packing.Index([c.astype(np.uint32) for c in common])
    unused = np.ones(len(common), bool)
    unused[:2] = False
    assert set(index.neighbours(common[0].astype(np.uint32), unused)) == {32, 33}


def test_pipeline_rejects_mixed_documents(spark, monkeypatch):
    import corpus_pipeline

    words = {"en": "the of and to with that this is for on by".split(), "de": "der die und nicht das mit auf von sich für dem".split(), "fr": "le la les des est pas que pour dans avec une".split()}
    rows = [(100 * k + i, prose(i, 80, w), lang) for k, (lang, w) in enumerate(words.items()) for i in range(40)]
    clean = [(1000 + k, " ".join(w * 6), lang) for k, (lang, w) in enumerate(words.items())]
    mixed = [(2000, " ".join(" ".join(w * 3) for w in words.values()), "en")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(train, F.lit(True))
    monkeypatch.setattr(language_id, "fit", lambda *_: model)
    asked = spark.createDataFrame([*clean, *mixed, (3000, "12 34", "en")], "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    share = {r.doc_id: r.score for r in language_id.label_spans(asked, model, ["doc_id"]).collect()}
    assert 0.3 <= share[2000] < 0.5
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, asked, "").collect()} == {1000, 1001, 1002}


def test_large_groups_that_chance_chains_are_compared_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 2)
    # thirty groups, each of which shares a set with the next; ten near copies with five signatures in common; sizes far apart
    rows = [(g, 5 * g + i, 20 + i % 2) for g in range(30) for i in range(6)]
    rows += [(100 + g, 1000 + i, 40 + i % 3) for g in range(5) for i in range(10)]
    rows += [(200, 2000 + i, n) for i, n in enumerate((10, 11, 30, 34, 100))]
    large = spark.createDataFrame(rows, "sig long, name long, n long").withColumn("node", F.col("name"))
    links = ngram_join._chained(large, 85).collect()
    up = {r[1]: r[1] for r in rows}
    for a, b in links:
        up = {x: up[b] if r == up[a] else r for x, r in up.items()}
    assert len({up[n] for n in range(151)}) == 1 and len({up[1000 + i] for i in range(10)}) == 1
    assert up[2000] == up[2001] != up[2002] == up[2003] != up[2004]
    assert sum(n >= 1000 and n < 2000 for n, _ in links) == 9
    roots = spark.createDataFrame(list(up.items()), "node long, root long")
    hoods: dict = {}
    for r in ngram_join._compared(large, roots).collect():
        hoods.setdefault(r.root, set()).add(r.name)
    sizes = sorted(len(h) for h in hoods.values())
    assert sizes.count(6) == 30 and sizes.count(10) == 1 and max(sizes) == 10
