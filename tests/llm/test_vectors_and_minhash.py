"""MinHash near duplicates, whitening and hard negatives against plain versions, and on odd tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import hard_negatives, minhash, ngram_join, queries, whitening
from tests.llm.test_operators import ODD, brute_components, docs, prose


def near_rows(seed, groups=9, most=25):
    rng, rows = random.Random(seed), [r for r in ODD if r[0] not in (5, 4)]
    for g in range(groups):
        base = prose(g + seed, rng.randint(6, 150)).split()
        for k in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(5)}"
            rows.append((1000 + 100 * g + k, " ".join(w[: len(w) - rng.randint(0, 3)])))
    shared = prose(77, 40)
    return rows + [(5000 + i, prose(900 + i, 60) + " " + shared) for i in range(15)]


@pytest.mark.parametrize(("width", "percent", "rounds", "tokens"), [(5, 85, 3, 500), (4, 80, 1, 200), (1, 75, 2, 800_000)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, width, percent, rounds, tokens):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BITMAP_TOKENS", tokens + 200)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", tokens)
    rows = near_rows(width)
    got = minhash.near_duplicates(docs(spark, rows), width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_empty_repeated_and_clashing_rows(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    long = prose(3, 30_000)
    rows = [(1, long), (2, long + " end"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "other words entirely here now then"), (4, None), (None, "a b c d e f g h"), (None, "")]
    d = docs(spark, rows)
    for c in ("bucket", "centre", "root", "block", "tokens", "id"):
        d = d.withColumn(c, F.lit("own"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, got[0][1], 1, True), (2, got[0][1] + 1, 1, False), (3, 4, 3, True), (3, 4, 3, True), (3, 2, 3, True), (4, 0, 4, True), (None, 4, 3, False), (None, 0, None, True)], key=str)
    with pytest.raises(ValueError):
        minhash.near_duplicates(d, percent=60)


def test_links_that_a_star_hides(spark):
    """The centre of every bucket links with some and not with others that these link with."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for chain in range(12):
        base = [f"{chain}{w}" for w in words]
        for k in range(8):
            rows.append((100 * chain + k, " ".join(base)))
            for i in rng.sample(range(400), 11):
                base[i] = f"{chain}new{k}{i}"
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 1, 85).collect()}
    assert got == {i: c for i, _, c in brute_components(rows, 1, 85)}


def test_sketches_fill_empty_bins_alike():
    rng = np.random.default_rng(3)
    t = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    s = minhash.sketch(t)
    for b in range(0, minhash.BINS, 17):
        inside = [int(x) for x in t if int(x) * minhash.BINS >> 64 == b]
        assert s[b] == min(inside)
    few = t[::700]
    s = minhash.sketch(few)
    own = {int(x) * minhash.BINS >> 64: int(x) for x in few[::-1]}
    for b in range(minhash.BINS):
        assert int(s[b]) == (own[b] if b in own else own[min(own, key=lambda j: minhash._ORDER[b, j])])  # noqa: B023
    # the share of agreeing bins is the similarity
    mixed = rng.permutation(t)
    like = [np.mean(minhash.sketch(np.sort(mixed[:k])) == minhash.sketch(np.sort(mixed[: k * 4 // 5]))) for k in (40, 400, 4000)]
    assert like == pytest.approx([0.8] * 3, abs=0.1)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, x, labels=None):
    rows = [(i, [float(c) for c in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [1.0, None, *[0.0] * (x.shape[1] - 2)], 1), (902, [float("nan")] * x.shape[1], 1), (903, [float("inf")] * x.shape[1], 1), (904, [0.5], 1), (905, [], 1)]
    return spark.createDataFrame(rows + bad, VECTORS)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))).astype(np.float32)
    x[150:] = x[3]
    df = vectors(spark, x).unionByName(spark.createDataFrame([(None, [float(c) for c in x[0]], None)], VECTORS)).withColumn("x", F.lit(1)).withColumn("_x", F.lit(2))
    model = whitening.fit(df, components=4)
    whole = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in x]
    fit = sorted(set(map(tuple, whole)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    assert (model.n, list(model.sums)) == (n, sums) and n <= 151
    centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(v, sums, strict=True)] for v in fit]
    cov = np.array([[float(sum(v[i] * v[j] for v in centred) / n) for j in range(6)] for i in range(6)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert model.explained == pytest.approx(e[:4] / np.trace(cov), rel=1e-9) and model.identity_error < 1e-9
    got = {r.vec_id: r for r in whitening.transform(df, model, ["vec_id", "x"]).collect()}
    assert set(got) == {*range(200), None} and got[0].x == 1
    for i in (0, 3, 160):
        c = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(whole[i], sums, strict=True)])
        assert np.abs(got[i].whitened) == pytest.approx(np.abs(c @ u[:, :4] / np.sqrt(e[:4])), rel=1e-8, abs=1e-9)
        assert got[i].deviation == sum((n * a - s) ** 2 for a, s in zip(whole[i], sums, strict=True))
    rows = queries.op12_whitening
    assert rows.__name__ in queries.QUERIES


def test_whitening_of_odd_tables(spark, tmp_path):
    one = np.ones((5, 3), np.float32)
    assert whitening.fit(vectors(spark, one)).projection.shape == (3, 0)
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.transform(empty, whitening.fit(empty), ["vec_id"]).count() == 0
    for rows in (empty, vectors(spark, one)):
        at = str(tmp_path / str(rows.isEmpty()))
        rows.write.parquet(f"{at}/embeddings.parquet")
        assert queries.op12_whitening(spark, at).count() == 0 and queries.op13_hard_negatives(spark, at).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.fit(vectors(spark, one * np.float32(1e20)))
    far = np.array([[2**45, 2**45 + 1]]) + 1_000_000
    with pytest.raises(OverflowError):
        whitening.deviations(far, 10**6, (1, 1))
    assert whitening.deviations(np.array([[3, 5]]), 2, (4, 7)).tolist() == [(6 - 4) ** 2 + (10 - 7) ** 2]


def brute_negatives(rows, every, positives=5, negatives=3):
    """rows: (id, label, whole-numbered vector)."""
    found = []
    for a, la, x in sorted({(i, lab, tuple(v)) for i, lab, v in rows if i % every == 0}):
        score = {(sum(p * q for p, q in zip(x, v, strict=True)), i, lab == la) for i, lab, v in rows if i != a}
        order = sorted(score, key=lambda s: (-s[0], s[1]))
        for p, i, same in [s for s in order if s[2]][:positives]:
            inside = [s for s in order if not s[2] and 50 * p <= 100 * s[0] <= 95 * p][:negatives]
            found += [(a, i, k + 1, s[1], p, s[0]) for k, s in enumerate(inside)]
    return sorted(found)


@pytest.mark.parametrize(("chunk", "anchors", "candidates"), [(16_384, 512, 4096), (7, 3, 11)])
def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch, chunk, anchors, candidates):
    for name, value in (("CHUNK", chunk), ("ANCHORS", anchors), ("CANDIDATES", candidates)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(160, 8)) + rng.normal(size=8) * 2, 1).astype(np.float32)
    x[100:130] = x[7]  # ties
    labels = rng.integers(0, 4, 160)
    df = vectors(spark, x, labels).unionByName(spark.createDataFrame([(None, [float(c) for c in x[0]], 1), (906, [float(c) for c in x[0]], None), *((10, [float(c) for c in x[10]], int(labels[10])),) * 2], VECTORS))
    df = df.withColumn("place", F.lit("own")).withColumn("list", F.lit("own")).withColumn("x", F.lit(0)).repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0)
    rows = [(i, int(labels[i]), [math.floor(256 * float(c)) for c in v]) for i, v in enumerate(x)]
    want = brute_negatives(rows, 5)
    assert len(want) > 150 and sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want


def test_products_are_exact():
    a, b = np.array([[2**30 + 1, 2**30 - 1]]), np.array([[2**30 + 3, 1], [5, 2**29 + 1]])
    assert hard_negatives.products(a, b).tolist() == [[sum(int(p) * int(q) for p, q in zip(a[0], v, strict=True)) for v in b]]
    assert hard_negatives.products(a // 2**20, b // 2**20).dtype == np.float64
    with pytest.raises(OverflowError):
        hard_negatives.products(a * 4, b * 4)
