"""The operators' methods against plain versions, and odd tables through all of them."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evidra.llm import bpe, chat, fingerprints, language_id, ngram_join, packing, quality, topk, toxicity
from tests.llm.test_operators import DOCS, brute_components, docs, prose

M32 = (1 << 32) - 1


def plain_sketch(text):
    """Order MinHash, one k-mer and one lane at a time."""
    h = [int(x) for x in fingerprints.kmers(text)]
    seen, numbered = {}, []
    for place, x in enumerate(h):
        number = seen[x] = seen.get(x, -1) + 1
        numbered.append((int(fingerprints._mix(np.array([x ^ (number * 0x9E3779B1 & M32)], np.uint32))[0]), place))
    mix, out = lambda x: int(fingerprints._mix(np.array([x & M32], np.uint32))[0]), []
    for lane in range(fingerprints.SKETCHES):
        rank = sorted((((c ^ int(fingerprints._XOR[lane, 0])) * int(fingerprints._MUL[lane, 0]) & M32), c, place) for c, place in numbered)
        picked = sorted(rank[:2], key=lambda x: x[2])
        value = picked[0][1] * 0x85EBCA77
        if len(picked) == 2:
            value += mix(picked[1][1] + 1)
        out.append(mix(value ^ int(fingerprints._LANE[lane])) >> 16)
    return out


@pytest.mark.parametrize("text", ["a", "short text", "x" * 90, prose(1, 60), prose(2, 40) + " " + prose(2, 40), "é漢字" * 30])
def test_sketches_are_those_of_a_plain_version(monkeypatch, text):
    monkeypatch.setattr(fingerprints, "PIECE", 37)
    assert fingerprints.sketch(text).tolist() == plain_sketch(text)


def test_compared_documents_are_those_of_a_plain_version(spark):
    rows = [(i * 3 % 101, prose(i, 20 + i)) for i in range(40)] + [(200, ""), (201, None), (203, "tail")]
    got = {r.doc_id: r for r in fingerprints.compare_with_edited(docs(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        mine, other, last = (plain_sketch(x) if x else None for x in (t, changed, following))
        like = lambda a, b: float(a == b) if a is None or b is None else np.mean([x == y for x, y in zip(a, b, strict=True)])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (like(mine, other), like(mine, last))


def test_quality_tables_are_added_bin_by_bin():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.boost(x, y, cycles=8, pair_cycles=8)
    plain = []
    for row in x:
        total = model.bias
        for j, (cuts, table) in enumerate(zip(model.cuts, model.tables, strict=True)):
            total += table[sum(c <= row[j] for c in cuts)]
        for a, b, cuts_a, cuts_b, table in model.pairs:
            total += table[sum(c <= row[a] for c in cuts_a)][sum(c <= row[b] for c in cuts_b)]
        plain.append(1 / (1 + math.exp(-total)))
    assert model.score(x) == pytest.approx(plain) and (0, 1) in [(a, b) for a, b, *_ in model.pairs]
    # a tree's first cut is the best one of all
    g, h = rng.normal(size=12), rng.random(12) + 2
    def gain(k):
        return g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1)

    k = max(range(1, 12), key=gain)
    step = quality._step(g, h, depth=1, least=0)
    assert step[:k] == pytest.approx(-g[:k].sum() / (h[:k].sum() + 1)) and step[k:] == pytest.approx(-g[k:].sum() / (h[k:].sum() + 1))


def plain_tree(g, h, depth):
    """A shallow tree over ordered bins, cut by cut."""
    n, base = len(g), -sum(g) / (sum(h) + 1)
    best = None
    for k in range(1, n) if depth else ():
        a, b, c, d = sum(g[:k]), sum(h[:k]), sum(g[k:]), sum(h[k:])
        if b >= 2 and d >= 2 and (best is None or a * a / (b + 1) + c * c / (d + 1) > best[0]):
            best = (a * a / (b + 1) + c * c / (d + 1), k)
    if best is None or best[0] <= sum(g) ** 2 / (sum(h) + 1) + 1e-9:
        return [base] * n
    return plain_tree(g[: best[1]], h[: best[1]], depth - 1) + plain_tree(g[best[1] :], h[best[1] :], depth - 1)


def plain_quadrants(rows, a, b):
    """The best cut of two axes together, of rows (bin, bin, gradient, hessian): gain, and the value of each cell."""
    best = None
    for i in range(1, a):
        for j in range(1, b):
            part: dict = {}
            for x, y, g, h in rows:
                s = part.setdefault((x >= i, y >= j), [0.0, 0.0])
                s[0], s[1] = s[0] + g, s[1] + h
            gain = sum(g * g / (h + 1) for g, h in part.values())
            if best is None or gain > best[0] + 1e-12:
                best = (gain, i, j, {k: -g / (h + 1) for k, (g, h) in part.items()})
    gain, i, j, value = best
    return gain, [[value.get((x >= i, y >= j), 0.0) for y in range(b)] for x in range(a)]


def test_quality_is_boosted_as_a_plain_version_does():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(150, 3)), 1)
    y = (((x[:, 0] > 0.2) ^ (x[:, 1] > 0)) | (x[:, 2] > 1)).astype(float)
    model = quality.boost(x, y, cycles=3, rate=0.3, n_pairs=2, pair_cycles=3)
    bins = [np.searchsorted(c, v, side="right") for c, v in zip(model.cuts, x.T, strict=True)]
    total = [math.log(y.mean() / (1 - y.mean()))] * 150
    tables = [[0.0] * (len(c) + 1) for c in model.cuts]

    def slopes():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]

    for _ in range(3):
        for j, table in enumerate(tables):
            g, h = slopes()
            tree = plain_tree([sum(v for v, b in zip(g, bins[j], strict=True) if b == k) for k in range(len(table))], [sum(v for v, b in zip(h, bins[j], strict=True) if b == k) for k in range(len(table))], 2)
            for k, v in enumerate(tree):
                table[k] += 0.3 * v
            total = [t + 0.3 * tree[b] for t, b in zip(total, bins[j], strict=True)]
    for own, table in zip(model.tables, tables, strict=True):
        assert own == pytest.approx(table, abs=1e-9)
    cuts = [np.unique(np.quantile(v, np.arange(1, quality.PAIR_BINS) / quality.PAIR_BINS)) for v in x.T]
    cells = [np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)]
    quadrants = lambda a, b: plain_quadrants([*zip(cells[a], cells[b], *slopes(), strict=True)], len(cuts[a]) + 1, len(cuts[b]) + 1)
    chosen = sorted([(0, 1), (0, 2), (1, 2)], key=lambda p: -quadrants(*p)[0])[:2]
    assert [(a, b) for a, b, *_ in model.pairs] == chosen and chosen[0] == (0, 1)
    grids = {p: np.zeros((len(cuts[p[0]]) + 1, len(cuts[p[1]]) + 1)) for p in chosen}
    for _ in range(3):
        for p in chosen:
            grid = 0.3 * np.array(quadrants(*p)[1])
            grids[p] += grid
            total = [t + grid[a][b] for t, a, b in zip(total, cells[p[0]], cells[p[1]], strict=True)]
    for a, b, _, _, table in model.pairs:
        assert table == pytest.approx(grids[a, b], abs=1e-9)


def plain_features(text):
    """Words, heads, pairs and skip pairs as a set of hashes."""
    from zlib import crc32

    m64 = (1 << 64) - 1
    words = toxicity.WORDS.findall(text.lower())
    of = lambda w: crc32(w.encode()) * 0x9E3779B97F4A7C15 & m64
    h = [of(w) for w in words]
    found = set(h) | {of("~" + w[:n]) for w in words for n in toxicity.Words.HEADS if len(w) > n}
    found |= {(a * 0xC2B2AE3D27D4EB4F + b) & m64 for a, b in zip(h, h[1:], strict=False)} | {(a * 0x165667B19E3779F9 + b * 3) & m64 for a, b in zip(h, h[2:], strict=False)}
    return {x >> (64 - toxicity.BITS) for x in found}


def plain_ftrl(rows, labels, alpha, beta, l1, l2, epochs):
    z, n, bias = {}, {}, -1
    share = min(max(sum(labels) / len(labels), 0.001), 0.999)
    weight = [max(1, math.sqrt(share / (1 - share))), max(1, math.sqrt((1 - share) / share))]

    def w(i):
        limit = 0 if i == bias else l1
        if abs(z.get(i, 0)) <= limit:
            return 0.0
        return -(z[i] - math.copysign(limit, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            own = [*row, bias]
            g = (1 / (1 + math.exp(-sum(map(w, own)))) - y) * weight[y]
            for i, v in [(i, w(i)) for i in own]:
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / alpha
                z[i], n[i] = z.get(i, 0) + g - sigma * v, n.get(i, 0) + g * g
    return w(bias), {i: w(i) for i in z if i != bias and w(i)}


def test_toxicity_is_that_of_a_plain_version():
    texts = [prose(i, 30) + (" vile rotten language" if i % 3 == 0 else "") for i in range(60)] + ["", "one", "Two words"]
    ids, cuts = toxicity.features(texts, toxicity.Words())
    rows = [np.unique(ids[a:b]).astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert [set(r.tolist()) for r in rows] == [plain_features(t) for t in texts]
    labels = [int("vile" in t) for t in texts]
    model = toxicity.ftrl(rows, np.array(labels, float), alpha=1.0, l1=1.0, epochs=2)
    bias, weights = plain_ftrl([r.tolist() for r in rows], labels, 1.0, 1.0, 1.0, 1.0, 2)
    assert model.bias == pytest.approx(bias) and dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(weights, rel=1e-5)


def test_toxicity_is_calibrated_on_unseen_rows():
    rng = np.random.default_rng(8)
    logits, labels = rng.normal(size=4000) * 3, np.zeros(4000)
    labels[rng.random(4000) < 1 / (1 + np.exp(-(0.5 * logits - 1.5)))] = 1
    assert toxicity.platt(logits, labels) == pytest.approx((0.5, -1.5), abs=0.15)
    assert all(np.isfinite(toxicity.platt(np.where(labels == 1, 40.0, -40.0), labels)))
    texts = [prose(i, 40) + (" vile" * (i % 3 == 0)) for i in range(90)]
    ids, cuts = toxicity.features(texts, toxicity.Words())
    rows, y = [np.unique(ids[a:b]).astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)], np.array([float("vile" in t) for t in texts])
    plain = toxicity.ftrl([r[np.bincount(np.concatenate(rows), minlength=toxicity.SIZE)[r] > 1] for r in rows], y, alpha=1.0, l1=1.0)
    model = toxicity.trained(rows, y, alpha=1.0, l1=1.0)
    scale = model.weight / plain.weight
    assert scale == pytest.approx(scale[0], rel=1e-4) and scale[0] > 0 and (model.index == plain.index).all()
    held = np.zeros(90)
    for k in range(3):
        rest = [i for i in range(90) if i % 3 != k]
        times = np.bincount(np.concatenate([rows[i] for i in rest]), minlength=toxicity.SIZE)
        m = toxicity.ftrl([rows[i][times[rows[i]] > 1] for i in rest], y[rest], alpha=1.0, l1=1.0)
        held[k::3] = [m.bias + m.dense()[rows[i]].sum() for i in range(k, 90, 3)]
    a, b = toxicity.platt(held, y)
    assert scale[0] == pytest.approx(a, rel=1e-3) and model.bias == pytest.approx(a * plain.bias + b, rel=1e-3)


def test_samples_bound_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = docs(spark, [(1, f"text {i}") for i in range(500)] + [(2, None), (2, "b")] + [(i, "x") for i in range(3, 40)])
    got = toxicity.sample_of(rows, labels, "toxic", F.lit(True), 10)
    assert got.count() <= 10 and {r.text for r in toxicity.sample_of(rows, labels.filter("doc_id < 3"), "toxic", F.lit(True), 10).collect()} == {"text 0", "b"}


def test_packing_asks_by_bm25():
    rng = np.random.default_rng(3)
    pieces = [rng.zipf(1.4, rng.integers(5, 60)).clip(1, 200).astype(np.uint32) for _ in range(40)]
    index, n = packing.Index(pieces), len(pieces)
    mean = np.mean([len(p) for p in pieces])
    for seed in range(0, 40, 7):
        terms = [t for t in np.unique(pieces[seed]) if sum(t in p for p in pieces) > 1][: packing.TERMS]
        unused = rng.random(n) < 0.8
        score = []
        for i, p in enumerate(pieces):
            total = 0.0
            for t in terms:
                df, tf = sum(t in q for q in pieces), int((p == t).sum())
                total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(p) / mean)) if tf else 0
            score.append(total * unused[i])
        want = sorted((i for i in range(n) if score[i] > 0), key=lambda i: (-round(score[i], 9), i))[: packing.NEIGHBOURS]
        got = index._best(np.array(terms, np.int64), unused)
        assert [round(score[i], 6) for i in got] == [round(score[i], 6) for i in want]


def test_packing_breaks_ties_by_row():
    index = packing.Index([np.arange(8, dtype=np.uint32)] * 300)
    unused = np.ones(300, bool)
    unused[[0, 3]] = False
    assert index.neighbours(np.arange(8), unused).tolist() == [i for i in range(300) if i not in (0, 3)][: packing.NEIGHBOURS]
    mixed = packing.Index([np.array([1, 2, 3, k % 3 + 5], np.uint32) for k in range(60)])
    got = mixed.neighbours(np.array([1, 2, 3, 6]), np.ones(60, bool))
    assert got.tolist() == list(range(1, 60, 3))[: packing.NEIGHBOURS]


def test_packing_fills_windows_with_neighbours(monkeypatch):
    """Each window, piece by piece: what may stand at each place follows from what is unused then."""
    monkeypatch.setattr(packing, "WINDOW", 256)
    rng = np.random.default_rng(7)
    docs_ = [rng.zipf(1.3, rng.integers(5, 250)).clip(1, 300).astype(np.uint32) for _ in range(120)]
    placed: dict = {}
    for d, start, length, sequence, offset in packing.pack_shard(docs_):
        placed.setdefault(sequence, []).append((offset, d, start, length))
    windows = [sorted(placed[s]) for s in sorted(placed)]
    index, left, unused, carried, sure = packing.Index(docs_), [len(d) for d in docs_], np.ones(120, bool), None, 0
    for window in windows:
        if sum(p[3] for p in window) < 256:
            break  # the last window, cut into powers of two
        room, seed, queue, large, asked = 256, None, [], None, False
        for _, d, start, length in window:
            assert start == len(docs_[d]) - left[d] and length == min(room, left[d])
            if seed is None:
                seed = d
                assert d == (carried if carried is not None else int(np.flatnonzero(unused)[0]))
                carried = None
            else:
                while True:
                    fits = [i for i in queue if unused[i] and left[i] <= room]
                    if fits:
                        want = fits[0]
                        break
                    if large is not None or (asked and not queue):
                        want = large
                        break
                    queue = index.neighbours(docs_[seed], unused).tolist()
                    asked = True
                    over = [i for i in queue if left[i] > room]
                    if not queue:
                        want = int(np.flatnonzero(unused)[0])
                        seed, asked = want, False
                        break
                    if over and not any(left[i] <= room for i in queue):
                        large = over[0]
                if d != want and large is None:
                    # a piece that didn't fit when the queue was passed is cut last
                    large = next((i for i in queue if unused[i] and left[i] > room), None)
                    want = large
                assert d == want, (d, want)
                sure += 1
            take, unused[d] = length, False
            left[d] -= take
            room -= take
            if left[d]:
                carried = d
    assert sure > 100


def plain_word_scores(rows, model, word):
    """Log shares of a word's n-grams among those of each language, from counts of all of its texts, one n-gram at a time."""
    buckets, _, _ = language_id.word_features([word])
    total = []
    for lang in model.languages:
        n = np.zeros(language_id.BUCKETS)
        for text, own in rows:
            if own == lang:
                for w in language_id.WORDS.findall(text.lower()):
                    np.add.at(n, language_id.word_features([w])[0], 1)
        n = (n + 0.1) / (n + 0.1).sum()
        total.append(np.log(n[buckets]).sum())
    return total


def test_word_features_do_not_depend_on_other_words():
    words = ["und", "the", "abc", "x", "слово"]
    buckets, owner, _ = language_id.word_features(words)
    assert all(sorted(buckets[owner == i].tolist()) == sorted(language_id.word_features([w])[0].tolist()) for i, w in enumerate(words))


def test_language_model_counts_all_rows(spark):
    rows = [(prose(i, 15, ["der", "und"] if i % 2 else ["the", "and"]), "de" if i % 2 else "en") for i in range(12)]
    df = spark.createDataFrame([(i if i % 3 else None, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").withColumn("key", F.lit("own"))
    model = language_id.fit(df, F.lit(True))
    assert model.languages == ("de", "en")
    for word in ("und", "the", "abcdef"):
        a, b = plain_word_scores(rows, model, word), model.word_scores([word])[0]
        assert b == pytest.approx(np.maximum(language_id.TEMPER * (np.array(a) - max(a)), -60), abs=1e-3)
    none = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert language_id.fit(none, F.lit(True)).languages == ("de", "en")


def plain_share(model, text):
    """The share of words under the language that most have, on the best path, step by step."""
    words = language_id.WORDS.findall((text or "").lower())
    if not words or not any(map(str.isalpha, text)):
        return 0.0
    scores = [model.word_scores([w])[0].astype(float) for w in words]
    value, came, k = list(scores[0]), [], len(model.languages)
    for s in scores[1:]:
        best = max(range(k), key=lambda j: value[j])
        step = [j if value[j] >= value[best] - language_id.SWITCH else best for j in range(k)]
        value = [max(value[j], value[best] - language_id.SWITCH) + s[j] for j in range(k)]
        came.append(step)
    path = [max(range(k), key=lambda j: value[j])]
    for step in reversed(came):
        path.append(step[path[-1]])
    return max(path.count(j) for j in range(k)) / len(path)


def test_pipeline_is_that_of_a_plain_version(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    en, de = "the of and to with that this is for on by".split(), "der die und nicht das mit auf von sich für dem".split()
    rows = [(i, prose(i, 60, en), "en") for i in range(60)] + [(100 + i, prose(100 + i, 60, de), "de") for i in range(40)]
    rows += [(200 + i, prose(200 + i, 40, en) + " vile rotten scum" * 2, "en") for i in range(24)]
    rows += [(300 + i, rows[i][1] + " end", "en") for i in range(9)] + [(400, None, None), (401, "12 34", "en"), (402, "", "de"), (5, rows[5][1], "en")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("vile" in (t or ""))) for i, t, _ in rows if i < 300 and i != 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    models = {}
    for module in (language_id, toxicity):
        fit = module.fit
        monkeypatch.setattr(module, "fit", lambda *a, f=fit, m=module, **k: models.setdefault(m, f(*a, **k)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t, _ in rows if plain_share(models[language_id], t) >= corpus_pipeline.LEAST_LANGUAGE_SHARE]
    weights = dict(zip(models[toxicity].index.tolist(), models[toxicity].weight.tolist(), strict=True))
    kept = [(i, t) for i, t in kept if 1 / (1 + math.exp(-models[toxicity].bias - sum(weights.get(x, 0) for x in plain_features(t)))) < corpus_pipeline.TOXIC]
    groups = brute_components(kept, 5, 80)
    left = sorted({c for _, _, c in groups})
    assert 60 <= len(left) < len(kept) and not any(200 <= i < 224 for i in left)
    enc = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    size = {i: len(packing.tokens(t, enc)) for i, t in kept}
    by: dict = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert sorted(by) == left
    for i, parts in by.items():
        assert sum(p[1] for p in parts) == size[i] == parts[0][2]


@pytest.mark.parametrize("column", ["score", "held_out", "label", "place", "name", "n", "bucket", "ids", "tokens"])
def test_clashing_columns_change_nothing(spark, column):
    d = docs(spark, [(1, prose(1, 30)), (2, prose(2, 30)), (3, None)]).drop("score", "name").withColumn(column, F.lit("own"))
    model = toxicity.ToxicityModel(-1.0, np.array([5]), np.array([1.0], np.float32))
    got = toxicity.score(d, model)
    assert got.count() == 3 and (column == "score" or {r[column] for r in got.collect()} == {"own"})
    assert ngram_join.near_duplicates(d).count() == 3 if column in ("name", "n") else True


def test_clashing_columns_change_no_operator(spark):
    rows = [(i, prose(i, 30) + (" vile" if i % 3 == 0 else "")) for i in range(30)] + [(40, None), (41, "")]
    plain = docs(spark, rows).drop("score", "name")
    clash = plain
    for c in ("score", "held_out", "label", "place", "key", "n", "bucket", "ids", "sig", "length", "start", "sequence_id", "fingerprint", "x", "spans", "id", "root", "token"):
        clash = clash.withColumn(c, F.lit("own"))
    path, labels = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    both = labels.withColumn("place", F.lit("own")).withColumn("text", F.lit("own")).withColumn("label", F.lit("own"))
    runs = {
        "op1": lambda d: fingerprints.compare_with_edited(d), "op2": lambda d: quality.score(d, quality.fit(d, both, F.lit(True)), ["doc_id"]), "op5": lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json"), digest=True).select("doc_id", "start", "length", "ids_crc32"),
        "op7": lambda d: bpe.digests(d, path), "op9": lambda d: language_id.label_spans(d, language_id.fit(d, F.lit(True)), ["doc_id"]), "op10": lambda d: toxicity.score(d, toxicity.fit(d, both, F.lit(True)), ["doc_id"]),
    }
    for name, run in runs.items():
        a, b = (sorted(map(str, run(d.repartition(2)).collect())) for d in (plain, clash))
        assert a == b and len(a) >= 32, name
    v = spark.createDataFrame([(i, [float((i * j) % 7 - 3) for j in range(16)]) for i in range(40)], "vec_id long, embedding array<float>")
    more = v.withColumn("code", F.lit("own")).withColumn("ids", F.lit("own")).withColumn("bound", F.lit(0))
    top = [sorted(map(str, topk.hamming_top_k(c := topk.sign_codes(d, 16), c.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), 3).collect())) for d in (v, more)]
    assert top[0] == top[1] and len(top[0]) == 24


def test_very_long_texts_and_empty_tables(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(190_000))
    joined = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_000_000))
    rows = [(1, long), (2, long + " end"), (3, joined), (4, None), (5, "")]
    d, none = docs(spark, rows).repartition(2), docs(spark, [])
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert len(long) > 1_000_000
    assert {r.doc_id: r.n_chars for r in fingerprints.compare_with_edited(d).collect()} == {i: len(t or "") for i, t in rows}
    sha = {r.doc_id: r.decoded_sha256 for r in bpe.digests(d, path).collect()}
    assert sha == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}
    group = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(d).collect()}
    assert group == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    tox = toxicity.ToxicityModel(-1.0, np.array([5]), np.array([1.0], np.float32))
    assert toxicity.score(d, tox).count() == 5 and toxicity.score(none, tox).count() == 0
    gam = quality.QualityModel(0.0, [np.empty(0)] * len(quality.FEATURES), [np.zeros(1)] * len(quality.FEATURES), [])
    assert {r.score for r in quality.score(d, gam).collect()} == {0.5} and quality.score(none, gam).count() == 0
    lid = language_id.LanguageModel(("a", "b"), np.zeros((language_id.BUCKETS, 2), np.float32), np.ones((language_id.N_SCRIPTS, 2), bool))
    assert {r.doc_id: r.lang_pred for r in language_id.label_spans(d, lid).collect()} == {1: "a", 2: "a", 3: "a", 4: "und", 5: "und"} and language_id.label_spans(none, lid).count() == 0
    pieces = packing.pack(d, public_tokenizers.path("byte_bpe_50k.json"), digest=True).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(pieces) == 5 and all(r.n == r["all"] for r in pieces)
    assert bpe.digests(none, path).count() == 0
    talk = spark.createDataFrame([(1, 0, "assistant", long), (1, 1, "user", None)], "conv_id long, turn long, role string, text string")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert chat.read_back(chat.format_chat(talk, ranks), ranks).first().loss_chars == len(long)
    assert chat.read_back(chat.format_chat(talk.limit(0), ranks), ranks).count() == 0
    assert topk.sign_codes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert "doc_id" in DOCS


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
