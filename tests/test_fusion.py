"""Fusion, gates, metrics and search on worked examples."""

import json

import pytest
from pyspark.sql import functions as F

from evidra.functions import draws
from evidra.functions.gating import BaselineThresholds, Thresholds
from evidra.operators import baselines, builders, datasets, experiments, fusion, integrity, metrics, resampling, running, tuning
from evidra.sources import files, readers, writers

COLUMNS = "sample_id string, claim_id string, doc_id string, pos int, evaluator string, evaluator_reliability double, doc_reliability double, p_support double, p_refute double, p_unknown double"


def rows(spark, *data):
    return spark.createDataFrame([("s", *d) for d in data], COLUMNS)


def claims(spark, *ids):
    return spark.createDataFrame([("s", i, "supported") for i in ids], "sample_id string, claim_id string, gold_state string")


def test_two_documents(spark):
    e = rows(spark, ("c", "1", 0, "e", 1.0, 1.0, 0.8, 0.1, 0.1), ("c", "2", 1, "e", 1.0, 1.0, 0.1, 0.8, 0.1))
    r = fusion.fuse_documents(e).first()
    assert r.k_doc == pytest.approx(0.65, abs=1e-12)
    assert (r.m_support, r.m_refute, r.m_theta) == pytest.approx((0.17 / 0.35, 0.17 / 0.35, 0.01 / 0.35), abs=1e-12)
    t = fusion.trace(e).first()
    assert t.m_support == pytest.approx(r.m_support, abs=1e-12) and t.steps[0].conflict == pytest.approx(0.65)


def test_statuses(spark):
    e = rows(
        spark, ("total", "1", 0, "e", 1.0, 1.0, 1.0, 0.0, 0.0), ("total", "2", 1, "e", 1.0, 1.0, 0.0, 1.0, 0.0),
        ("weak", "1", 0, "a", 0.0, 1.0, 1.0, 0.0, 0.0), ("weak", "2", 1, "a", 0.0, 1.0, 0.0, 1.0, 0.0), ("weak", "1", 0, "b", 1.0, 1.0, 0.9, 0.0, 0.1), ("weak", "2", 1, "b", 1.0, 1.0, 0.9, 0.0, 0.1),
        ("gone", "1", 0, "a", 0.0, 1.0, 1.0, 0.0, 0.0), ("gone", "2", 1, "a", 0.0, 1.0, 0.0, 1.0, 0.0),
        ("split", "1", 0, "a", 1.0, 1.0, 1.0, 0.0, 0.0), ("split", "1", 0, "b", 1.0, 1.0, 0.0, 1.0, 0.0),
    )
    found = {r.claim_id: r for r in fusion.run_pipeline(claims(spark, "total", "weak", "gone", "split", "none"), e, Thresholds()).collect()}
    assert (found["total"].status, found["total"].primary_state, found["total"].k_doc, found["total"].m_support) == ("document_total_conflict", "conflicting", 1.0, None)
    assert (found["weak"].status, found["weak"].primary_state) == ("normal", "supported")
    assert (found["gone"].status, found["gone"].primary_state, found["gone"].m_theta) == ("normal", "insufficient", 1.0)
    assert (found["split"].status, found["split"].primary_state, found["split"].evaluator_disagreement, found["split"].evidence_insufficient) == ("evaluator_total_conflict", None, True, False)
    assert (found["none"].status, found["none"].primary_state) == ("no_contexts", "insufficient")


def folded(masses):
    """Masses combined one after another, with the accumulated conflict."""
    from fractions import Fraction as Q

    s, r, t, kept = Q(0), Q(0), Q(1), Q(1)
    for a, b, c in masses:
        a, b, c = map(Q, (a, b, c))
        total = 1 - s * b - r * a
        s, r, t, kept = (s * a + s * c + t * a) / total, (r * b + r * c + t * b) / total, t * c / total, kept * total
    return float(s), float(r), float(t), 1 - float(kept)


def test_many_documents_are_exact(spark):
    kinds = {
        "even": [(0.5, 0.5, 0.0)] * 60, "lean": [(0.625, 0.359375, 0.015625)] * 80, "long": [(0.5, 0.4375, 0.0625), (0.375, 0.5, 0.125)] * 700,
        "sure": [(0.4375, 0.5, 0.0625)] * 900 + [(1.0, 0.0, 0.0)], "void": [(0.0, 0.0, 1.0)] * 5, "one": [(0.25, 0.5, 0.25)] * 900,
    }
    e = rows(spark, *((k, str(i), i, "e", 1.0, 1.0, *m) for k, v in kinds.items() for i, m in enumerate(v)))
    found = {r.claim_id: r for r in fusion.fuse_documents(e).collect()}
    for k, v in kinds.items():
        r = found[k]
        assert not r.document_total_conflict and (r.m_support, r.m_refute, r.m_theta, r.k_doc) == pytest.approx(folded(v), abs=1e-9), k
    # the order of documents doesn't matter
    back = fusion.fuse_documents(e.withColumn("pos", -F.col("pos")).repartition(7)).filter("claim_id = 'long'").first()
    assert back.m_support == pytest.approx(found["long"].m_support, abs=1e-12)


def test_near_total_conflict(spark):
    e = rows(
        spark, ("tiny", "1", 0, "e", 1.0, 1.0, 1 - 1e-13, 0.0, 1e-13), ("tiny", "2", 1, "e", 1.0, 1.0, 0.0, 1 - 1e-13, 1e-13),
        ("some", "1", 0, "e", 1.0, 1.0, 1 - 1e-6, 0.0, 1e-6), ("some", "2", 1, "e", 1.0, 1.0, 0.0, 1 - 1e-6, 1e-6),
        ("later", "1", 0, "e", 1.0, 1.0, 1.0, 0.0, 0.0), ("later", "2", 1, "e", 1.0, 1.0, 0.5, 0.25, 0.25), ("later", "3", 2, "e", 1.0, 1.0, 0.0, 1.0, 0.0),
    )
    found = {r.claim_id: (r.document_total_conflict, r.m_support) for r in fusion.fuse_documents(e).collect()}
    assert found["tiny"] == (True, None) and found["later"] == (True, None) and found["some"] == (False, pytest.approx(0.5, abs=1e-6))
    assert {r.claim_id: r.document_total_conflict for r in fusion.trace(e).collect()} == {k: v[0] for k, v in found.items()}


def test_reliability_outside_its_range_is_an_error(spark):
    for bad in (1.5, -0.1, float("nan")):
        with pytest.raises(Exception, match="reliability"):
            fusion.fuse_documents(rows(spark, ("c", "1", 0, "e", 1.0, bad, 0.5, 0.5, 0.0))).collect()


def test_baselines_and_gates(spark):
    e = rows(spark, ("c", "1", 0, "e", 1.0, 1.0, 0.5, 0.5, 0.0), ("d", "1", 0, "e", 1.0, 0.0, 1.0, 0.0, 0.0))
    out = {(r.claim_id, r.method): r for r in baselines.run_baselines(claims(spark, "c", "d"), e, BaselineThresholds(), "e").collect()}
    assert out["c", "conflict_aware"].state == "conflicting" and out["c", "weighted_average"].reason == "score_tie"
    assert out["c", "majority_vote"].score_unknown == 1.0 and out["d", "weighted_average"].reason == "no_evidence"
    with pytest.raises(Exception, match="evaluator x has no relation"):
        baselines.run_baselines(claims(spark, "c", "none"), e, BaselineThresholds(), "x").collect()
    alone = baselines.decide(claims(spark, "none"), baselines.single_scores(e, "x"), "single_evaluator", BaselineThresholds()).first()
    assert (alone.state, alone.reason, alone.input_count) == ("insufficient", "no_evidence", 0)
    even = rows(spark, *((f"c{k}", str(i), i, "e", 0.7, 0.3 + 0.1 * (i % 3), 0.1 * k, 0.1, 1 - 0.1 * k - 0.1) for k in range(1, 8) for i in range(7)))
    assert {r.conflict_sr_std for r in baselines.stat_gate_scores(claims(spark, *(f"c{k}" for k in range(1, 8))), even).collect()} == {0.0}
    s = baselines.stat_gate_scores(claims(spark, "c", "d"), e).orderBy("claim_id").collect()
    assert s[0].conflict_max_product == 0.25 and s[1].insufficiency_uprod == 1.0


def test_metrics(spark):
    p = spark.createDataFrame([("supported", "supported"), ("supported", "refuted"), ("refuted", "refuted"), ("refuted", "undetermined")], "gold_state string, predicted string")
    r = metrics.classification_report(p.withColumn("m", F.lit("x")), ["m"]).first()
    assert r.accuracy == 0.5 and r.macro_f1 == pytest.approx((2 / 3 + 0.5) / 2)
    d = spark.createDataFrame([("a", 0.9, 1), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.1, 0), ("b", 0.1, 0)], "name string, score double, positive int")
    found = {x.name: x for x in metrics.detection_report(d, ["name"]).collect()}
    assert found["a"].auroc == pytest.approx(0.875) and found["b"].auroc is None and found["a"].best_threshold == 0.5


def test_search_ties_take_the_least(spark):
    df = spark.createDataFrame([("supported", 0.9, 0.0, 0.1, 0.0)], "gold_state string, m_support double, m_refute double, m_theta double, k_doc double")
    best = tuning.search_gates(df, tuning.gate_grid([0.3, 0.2], [0.5, 0.4], df), []).first()
    assert (best.theta, best.conflict) == (0.2, 0.4)
    assert [r.value for r in tuning.observed_grid(df.union(df), "m_theta", 3).collect()] == [0.1]


def test_integrity(spark):
    ctx = spark.createDataFrame([("s", "1", 0), ("s", "2", 1)], "sample_id string, doc_id string, pos int")
    e = rows(spark, ("c", "1", 0, "e", 1.0, 1.0, 0.5, 0.5, 0.5), ("x", "9", 0, "e", 1.0, 1.0, 0.5, 0.5, 0.0))
    kinds = {r.kind for r in integrity.violations(claims(spark, "c", "n"), ctx, e).collect()}
    assert kinds == {"bad_probabilities", "unknown_claim", "unknown_document", "missing_relation", "no_evaluator"}


def test_paired_bootstrap_is_that_of_drawn_claims(spark):
    import numpy as np

    from evidra.plans import queries

    d, states = "/root/testdata/sf0.001", ["supported", "refuted", "insufficient", "conflicting"]
    ds = {r.claim_id: (r.gold_state, r.primary_state) for r in queries.QUERIES["pipeline_diagnostics"](spark, d).collect()}
    wa = {r.claim_id: r.state for r in queries.QUERIES["weighted_average"](spark, d).collect()}
    gold, a, b = (np.array(x) for x in zip(*((g, p or "undetermined", wa[i]) for i, (g, p) in ds.items()), strict=True))

    def score(metric, t, p):
        f1 = [2 * ((t == s) & (p == s)).sum() / max((t == s).sum() + (p == s).sum(), 1) for s in states]
        return (t == p).mean() if metric == "accuracy" else np.mean(f1)

    own = spark.createDataFrame([(i, g, p, q) for i, (g, p, q) in enumerate(zip(gold.tolist(), a.tolist(), b.tolist(), strict=True))], "claim_id long, gold_state string, predicted_a string, predicted_b string")
    rng, found = np.random.default_rng(7), {r.metric: r for r in resampling.paired_bootstrap(own, 1500).collect()}
    drawn = [rng.integers(0, len(gold), len(gold)) for _ in range(2000)]
    for metric in ("accuracy", "macro_f1"):
        r, ds = found[metric], np.sort([score(metric, gold[i], a[i]) - score(metric, gold[i], b[i]) for i in drawn])
        assert (r.n_claims, r.n_resamples) == (1500, 1500)
        assert r.difference == pytest.approx(score(metric, gold, a) - score(metric, gold, b), abs=1e-6)
        assert (r.low, r.high) == pytest.approx((ds[50], ds[1950]), abs=0.15 * (ds[1950] - ds[50]))
        assert r.p_value == pytest.approx(min(1.0, 2 * min((ds <= 0).mean(), (ds >= 0).mean())), abs=0.05)


def test_paired_bootstrap_of_equals_is_null(spark):
    p = spark.createDataFrame([(1, "supported", "refuted", "refuted"), (2, "refuted", "refuted", "refuted")], "claim_id int, gold_state string, predicted_a string, predicted_b string")
    assert {(r.metric, r.difference, r.low, r.high, r.p_value) for r in resampling.paired_bootstrap(p, 50).collect()} == {("accuracy", 0.0, 0.0, 0.0, 1.0), ("macro_f1", 0.0, 0.0, 0.0, 1.0)}


def test_documents_are_dealt_to_all_benchmark_items(spark, tmp_path):
    from evidra.plans import queries

    # gaps between the ids, and more than 40 items; only the second window holds the words of the document's own item
    spark.createDataFrame([(3 * i + 5, f"item{i}") for i in range(90)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, "filler " * 150 + f"item{k % 90}") for k in range(180)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["passage_tfidf_top1"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == list(range(180))
    assert all(r.passage == 1 and r.score > 0 for r in found)


def test_windows_reach_the_end_of_long_texts(spark, tmp_path):
    from evidra.plans import queries

    spark.createDataFrame([(0, "w " * 30_100 + "end"), (1, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "the end")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = queries.QUERIES["passage_windows"](spark, str(tmp_path)).filter("doc_id = 0").collect()
    assert max(r.start for r in found) == 30_000 and len(found) == 501
    best = queries.QUERIES["passage_tfidf_top1"](spark, str(tmp_path)).filter("doc_id = 0").first()
    assert best.passage == 500 and best.score > 0
    cut = datasets.windows(spark.read.parquet(str(tmp_path / "documents.parquet")), "doc_id", "text", most=30_000)
    assert {(r.doc_id, r.truncated, r.n) for r in cut.groupBy("doc_id", "truncated").agg(F.count("*").alias("n")).collect()} == {(0, True, 499), (1, False, 1)}


def test_checking_outputs(spark):
    df = spark.createDataFrame([("q", ["a", "b"], [["Entailment", " neutral"], ["contradiction", "entailment"]], [[[0.2, 0.3, 0.5], [1.0, 0.0, 0.0]]])], "query_id string, doc_ids array<string>, labels array<array<string>>, probabilities array<array<array<double>>>")
    assert datasets.checking_labels(df).filter("doc_id = 'b' AND claim = 1").first().n_entailment == 1
    p = {r.doc_id: r for r in datasets.checking_probabilities(df).collect()}
    assert (p["a"].p_support, p["a"].p_refute, p["a"].p_unknown) == pytest.approx((0.2, 0.5, 0.3))


def test_readers_and_writers(spark, tmp_path):
    good = {"sample_id": "s", "claim_id": "c", "doc_id": "d", "evaluator": "e", "p_support": 0.5, "p_refute": 0.25, "p_unknown": 0.25}
    (tmp_path / "r.jsonl").write_text("﻿" + json.dumps(good) + "\n\n" + json.dumps(good | {"evaluator": "f"}) + "\n", encoding="utf-8")
    df = readers.read_relations(spark, str(tmp_path / "r.jsonl"))
    assert df.count() == 2 and df.first().evaluator_reliability == 1.0
    (tmp_path / "bad.jsonl").write_text(json.dumps(good | {"other": 1}) + "\n")
    with pytest.raises(Exception, match="not a valid record"):
        readers.read_relations(spark, str(tmp_path / "bad.jsonl")).collect()
    writers.write_jsonl(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_jsonl(df, str(tmp_path / "out"))
    at = str(tmp_path / "m.json")
    files.write_manifest(spark, files.artifact(spark, str(tmp_path / "r.jsonl")), at)
    assert files.artifact(spark, str(tmp_path / "r.jsonl"))["records"] == 2
    files.verify_artifact(spark, str(tmp_path), files.read_mapping(spark, at))
    with pytest.raises(FileExistsError):
        files.write_manifest(spark, {}, at)
    (tmp_path / "r.jsonl").write_text("changed\n")
    with pytest.raises(ValueError, match="manifest"):
        files.verify_artifact(spark, str(tmp_path), files.read_mapping(spark, at))
    (tmp_path / "two.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"p_support": "x y"}) + "\nnot json\n")
    found = readers.bad_lines(spark, str(tmp_path / "two.jsonl"), readers.RELATION, ["sample_id", "p_support"])
    assert [line for _, line, _ in found] == [3, 4]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_relations(spark, str(tmp_path / "none.jsonl"))


SAMPLES = [("s1", "q", "a", None, [("s1-c1", "first")], [("s1-d1", "text", None, 0.5), ("s1-d2", "more", None, None)], "supported")]


def test_verified_datasets(spark, tmp_path):
    at = f"file://{tmp_path}"
    samples = spark.createDataFrame(SAMPLES, readers.SAMPLE)
    relations = spark.createDataFrame([("s1", "s1-c1", f"s1-d{i}", "nli", 0.5, 0.25, 0.25, 1.0) for i in (1, 2)], readers.RELATION)
    writers.write_samples(samples, f"{at}/train_samples")
    writers.write_relations(relations, f"{at}/train_nli")
    own = files.artifact(spark, f"{at}/train_samples")
    files.write_manifest(spark, files.dataset_manifest("d", {}, 42, {"train": 1}, {}, {"train": {"samples": own, "relation_predictions": None}}), f"{at}/manifest.json")
    run = files.model_run(spark, "d", "train", "nli", "us", "model", own, f"{at}/train_nli", f"{at}/train_nli", {}, "continuous_probabilities")
    files.write_manifest(spark, run, f"{at}/train_nli_run.json")
    s, r = readers.read_verified(spark, f"{at}/manifest.json", at + "/{split}_{evaluator}", ["nli"], at + "/{split}_{evaluator}_run.json", ["train"])
    assert r.count() == 2 and [c.reliability for c in s.first().contexts] == [0.5, 1.0]
    assert integrity.grid_violations(r, s, "nli").count() == 0 and integrity.empty_samples(s).count() == 0
    assert {x.kind for x in integrity.grid_violations(r.limit(1).unionByName(r.limit(1)).withColumn("doc_id", F.lit("s1-d9")), s, "other").collect()} == {"missing", "extra", "repeated", "other_evaluator"}
    with pytest.raises(ValueError, match="calibration"):
        files.model_run(spark, "d", "train", "nli", "us", "model", own, f"{at}/train_nli", f"{at}/train_nli", {}, "default", calibration="x")
    files.verify_split(spark, f"{at}/manifest.json", f"{at}/train_samples", None, "train")
    with pytest.raises(ValueError):
        files.verify_split(spark, f"{at}/manifest.json", f"{at}/train_nli", None, "train")
    (tmp_path / "c.yaml").write_text("paths:\n  samples: train_samples\n  relations: nowhere\n  output: out\ntheta: 0.5\n")
    with pytest.raises(ValueError, match="relations"):
        files.read_config(spark, f"{at}/c.yaml")
    assert files.read_config(spark, f"{at}/c.yaml", ("samples",))["paths"]["output"] == f"{at}/out"
    rows = writers.pipeline_rows(fusion.run_pipeline(readers.claims_of(s).select("sample_id", "claim_id", "gold_state"), fusion.join_evidence(r, readers.contexts_of(s)), Thresholds()), s)
    writers.write_pipeline_csv(rows, f"{at}/flat")
    flat = spark.read.option("header", True).csv(f"{at}/flat").first()
    assert (flat.claim_text, flat.context_count, flat.evaluators, list(flat.asDict())) == ("first", "2", "nli", writers.PIPELINE_COLUMNS)
    base = baselines.run_baselines(readers.claims_of(s).select("sample_id", "claim_id", "gold_state"), fusion.join_evidence(r, readers.contexts_of(s)), BaselineThresholds(), "nli")
    writers.write_baseline_csv(base, f"{at}/base", "nli")
    assert spark.read.option("header", True).csv(f"{at}/base").count() == 4
    assert writers.checking_inputs(s).first().retrieved_context[1].text == "more"


def test_builders(spark, tmp_path):
    fever = {"claim_id": "7", "claim": " A claim ", "claim_label": "DISPUTED", "evidences": [{"evidence_id": "e", "evidence_label": "REFUTES", "article": "x", "evidence": " t ", "entropy": 0.5, "votes": [None, None]}, {"evidence_id": "f", "evidence_label": "SUPPORTS", "article": "y", "evidence": "u", "entropy": 0.1, "votes": ["SUPPORTS", None, "REFUTES"]}]}
    (tmp_path / "f.jsonl").write_text(json.dumps(fever) + "\n")
    source = readers.read_fever(spark, str(tmp_path / "f.jsonl"))
    one = builders.fever_samples(source).first()
    assert (one.sample_id, one.answer, one.gold_state, one.contexts[1].doc_id) == ("climate-fever-0007", "A claim", "conflicting", "climate-fever-0007-d2")
    votes = {r.doc_id[-2:]: (r.p_support, r.p_refute, r.p_unknown) for r in builders.vote_relations(source).collect()}
    assert votes == {"d1": (0.0, 1.0, 0.0), "d2": (0.5, 0.5, 0.0)}
    assert builders.fever_provenance(source.withColumn("split", F.lit("test"))).first().contexts[0].article == "x"
    with pytest.raises(Exception, match="unknown label"):
        builders.fever_samples(source.withColumn("claim_label", F.lit("OTHER"))).collect()
    qa = [{"claim": "c", "label": "Supported", "questions": [{"question": "Why?", "answers": [{"answer": "Yes", "answer_type": "Boolean", "boolean_explanation": "so", "source_url": "u", "source_medium": "m"}]}]}, {"claim": "  ", "label": "Refuted", "questions": []}, {"claim": "d", "label": "Refuted", "questions": []}]
    (tmp_path / "qa.json").write_text(json.dumps(qa))
    rows = readers.read_qa_source(spark, {"dev": str(tmp_path / "qa.json")})
    found = {r.sample_id: r for r in builders.qa_samples(rows).collect()}
    assert set(found) == {"averitec-dev-0000", "averitec-dev-0002"} and found["averitec-dev-0002"].contexts == []
    assert found["averitec-dev-0000"].contexts[0].text == "Question: Why? Answer: Yes. so"
    assert builders.qa_provenance(rows.withColumn("split", F.lit("x"))).count() == 3 and readers.read_qa_claims(spark, str(tmp_path / "qa.json")).count() == 2
    claims_ = spark.createDataFrame([("w1", "green apples fall"), ("w2", "zebra")], "sample_id string, text string")
    pages = spark.createDataFrame([("w1", 1, "nothing here " * 5 + "green apples fall down", "https://www.a.b.example/x"), ("w1", 2, "  ", "u"), ("w2", 3, "zebra zebra", None)], "sample_id string, evidence_id int, content string, url string")
    media = spark.createDataFrame([("b.example", "high")], "domain string, credibility string")
    web = {r.sample_id: r for r in builders.web_contexts(claims_, pages, media, {"high": 0.9}, 0.4, size=6, stride=3).collect()}
    assert "green apples" in web["w1"].text and web["w1"].reliability == 0.9 and web["w2"].reliability == 0.4 and web["w2"].doc_id == "w2-d1"
    with pytest.raises(Exception, match="no value"):
        builders.web_contexts(claims_, pages, media, {"low": 0.1}, 0.4).collect()


def test_balanced_split(spark):
    df = spark.createDataFrame([(i, f"Text {i // 2}" if i % 2 else f"TEXT  {i // 2} ", "ab"[i // 2 % 2]) for i in range(80)], "id long, text string, label string")
    got = builders.balanced_split(df, "text", "label", F.col("id"), {"train": 5, "validation": 3, "test": 4}).collect()
    assert len({r.id // 2 for r in got}) == 24 and all(r.id % 2 == 0 for r in got)
    import collections

    assert collections.Counter((r.label, r.split) for r in got) == {(k, s): n for k in "ab" for s, n in (("train", 5), ("validation", 3), ("test", 4))}
    with pytest.raises(ValueError):
        builders.balanced_split(df, "text", "label", F.col("id"), {"train": 21})
    folds = spark.createDataFrame([("Straße ΟΔΟΣ",), ("STRASSE  οδος",), ("strasse οδοσ",)], "t string").select(datasets.normalised_text(F.col("t")).alias("n")).distinct()
    assert folds.count() == 1


def test_checking_results_are_strict(spark):
    df = spark.createDataFrame([("q", ["a", "b"], [["Entailment", "other"]])], "query_id string, doc_ids array<string>, labels array<array<string>>")
    with pytest.raises(Exception, match="unknown label"):
        datasets.checking_labels(df).collect()
    own = spark.createDataFrame([("q", "b", 0), ("q", "a", 1)], "sample_id string, doc_id string, pos int")
    with pytest.raises(Exception, match="documents differ"):
        builders.aligned(df, own).collect()
    counts = spark.createDataFrame([("q", "a", 1, 1, 0)], "query_id string, doc_id string, n_entailment long, n_neutral long, n_contradiction long")
    r = builders.relations_from_counts(counts, {"entailment": (1, 0, 0), "neutral": (0, 0, 1), "contradiction": (0, 1, 0)}, "m").first()
    assert (r.p_support, r.p_refute, r.p_unknown) == (0.5, 0.0, 0.5)
    seen = datasets.calibrate_labels(spark.createDataFrame([("neutral", 1.0, 0.2, 0.2, 0.6)], "label string, weight double, p_support double, p_refute double, p_unknown double"))
    default = {"neutral": (0, 0, 1), "entailment": (1, 0, 0)}
    assert {x.label: x.used_default for x in datasets.with_unseen(seen, default, True).collect()} == {"neutral": False, "entailment": True}
    with pytest.raises(Exception, match="never seen"):
        datasets.with_unseen(seen, default).collect()
    text = spark.createDataFrame([("plain",), ('{"claim": " c "}',)], "t string").select(builders.claim_text(F.col("t")).alias("t"))
    assert [x.t for x in text.collect()] == ["plain", "c"]


def test_streaming_equals_batch(spark, tmp_path):
    from evidra.streaming.fusion import streaming_fusion

    e = rows(spark, ("c", "1", 0, "e", 1.0, 1.0, 0.8, 0.1, 0.1), ("c", "2", 1, "e", 1.0, 0.5, 0.1, 0.8, 0.1))
    e.write.parquet(str(tmp_path / "in"))
    q = streaming_fusion(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("fused").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fused").first().m_support == pytest.approx(fusion.fuse_documents(e).first().m_support)


def test_entry_works(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1500


def plain_auroc(score, positive, w):
    up, down = [(s, x) for s, p, x in zip(score, positive, w, strict=True) if p], [(s, x) for s, p, x in zip(score, positive, w, strict=True) if not p]
    total = sum(x for _, x in up) * sum(x for _, x in down)
    return sum(x * y * ((a > b) + (a == b) / 2) for a, x in up for b, y in down) / total if total else None


def plain_weight(key, resample, seed):
    """A Poisson draw from a key's digest and a counter, number by number."""
    import hashlib
    import math

    digest, full = hashlib.md5(key.encode()).hexdigest(), 2**31

    def mixed(x):
        x ^= x >> 15
        x = x * draws.FIRST % full
        x ^= x >> 12
        x = x * draws.SECOND % full
        return x ^ x >> 15

    a, b = (int(digest[i : i + 8], 16) % full for i in (0, 8))
    x = mixed(mixed((a + (resample + seed * 1_000_003) * draws.STEP) % full) ^ b)
    total, k = math.exp(-1), 0
    while k < 10 and x >= int(full * total):
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k


def test_draws_are_those_of_a_plain_version(spark):
    rows = spark.createDataFrame([("s", i) for i in range(3000)], "sample_id string, claim_id int")
    got = {(r.claim_id, r.resample): r.w for r in draws.resampled(rows, ["sample_id", "claim_id"], 8, 3).collect()}
    assert len(got) == 9 * 3000 and all(got[i, -1] == 1 for i in range(3000))
    assert all(got[i, k] == plain_weight(f"s/{i}", k, 3) for i in range(0, 3000, 37) for k in range(8))
    import numpy as np

    w = np.array([[got[i, k] for k in range(8)] for i in range(3000)], float)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.04)
    # draws of a row under two numbers, and of two rows, have nothing to do with each other
    assert np.abs(np.corrcoef(w.T) - np.eye(8)).max() < 0.06 and abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.03


@pytest.mark.parametrize("one_bucket", [True, False])
def test_resampled_auroc_and_risk_are_those_of_repeated_rows(spark, monkeypatch, one_bucket):
    import numpy as np

    if not one_bucket:
        monkeypatch.setattr(running, "ONE_BUCKET", -1)
        monkeypatch.setattr(running, "BUCKETS", 5)
    rng = np.random.default_rng(4)
    n = 60
    data = [(name, i * 7919, float(np.round(rng.random(), 1)) if i > 25 else 0.5, int(i % 3 == 0), i) for name in ("a", "b") for i in range(n)]
    df = spark.createDataFrame(data, "name string, id long, score double, positive int, order_key long")
    w = np.array([[plain_weight(str(i * 7919), k, 3) for k in range(12)] for i in range(n)])
    found = {(r.name, r.resample): r.auroc for r in resampling.auroc_resamples(df, 12, 3).collect()}
    risk = {(r.name, r.resample): r.aurc for r in resampling.aurc_resamples(df.withColumnsRenamed({"score": "risk_score", "positive": "correct"}), 12, 3).collect()}
    for name in ("a", "b"):
        score, positive = zip(*((d[2], d[3]) for d in data if d[0] == name), strict=True)
        for k in range(-1, 12):
            times = w[:, k] if k >= 0 else np.ones(n, int)
            assert found[name, k] == pytest.approx(plain_auroc(score, positive, times))
            order = sorted(range(n), key=lambda i: (score[i], i))
            drawn = np.array([positive[i] for i in order for _ in range(int(times[i]))])
            want = np.mean([1 - drawn[: (m := max(1, int(np.rint(len(drawn) * c))))].sum() / m for c in metrics.coverages()])
            assert risk[name, k] == pytest.approx(want), (name, k)


def test_bootstraps_compare(spark):
    n = 400
    rows = [(m, i, (i % 10) / 10 if m == "good" else ((i * 37) % 11) / 11, int(i % 10 > 5), i) for m in ("good", "poor") for i in range(n)]
    df = spark.createDataFrame(rows, "name string, id long, score double, positive int, order_key long")
    r = resampling.paired_auroc_bootstrap(df, "good", 200).first()
    assert r.auroc_reference == 1.0 and r.low > 0.3 and r.p_value < 0.05 and r.n_resamples == 200
    risky = df.select("name", "id", (1 - F.col("score")).alias("risk_score"), "order_key", F.col("positive").alias("correct"))
    by = {x.metric: x for x in resampling.paired_selective_bootstrap(risky, "good", 100).collect()}
    assert by["auroc"].low > 0 and by["aurc"].high < 0
    with pytest.raises(Exception, match="both classes"):
        resampling.paired_auroc_bootstrap(df.filter("positive = 1"), "good", 5).collect()
    p = spark.createDataFrame([(i, "supported" if i < 30 else "refuted", "supported") for i in range(40)], "claim_id int, gold_state string, predicted string")
    found = {x.metric: x for x in resampling.bootstrap_interval(p, 500).collect()}
    assert found["accuracy"].observed == 0.75 and found["accuracy"].low < 0.75 < found["accuracy"].high and found["accuracy"].n_claims == 40
    # few positives: resamples of one class are left out
    rare = spark.createDataFrame([(m, i, float(i), int(i == 0)) for m in ("a", "b") for i in range(5)], "name string, id long, score double, positive int")
    assert resampling.paired_auroc_bootstrap(rare, "a", 100).first().n_resamples == sum(0 < plain_weight("0", k, 42) and any(plain_weight(str(i), k, 42) for i in range(1, 5)) for k in range(100))
    run = p.selectExpr("'m' method", "cast(claim_id as string) sample_id", "cast(claim_id as string) claim_id", "gold_state", "predicted")
    assert {x.difference for x in resampling.compare_runs(run, run, 20).collect()} == {0.0}
    with pytest.raises(Exception, match="same claims"):
        resampling.compare_runs(run, run.filter("claim_id < 5"), 20).collect()


def test_running_sums_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(running, "ONE_BUCKET", -1)
    monkeypatch.setattr(running, "BUCKETS", 8)
    data = [(i % 2, float(i * i % 13) if i % 3 else 4.0, i) for i in range(200)]
    df = spark.createDataFrame(data, "k int, v double, i long")
    place = running.bucket(F.col("v"), running.edges(df, "v"), F.col("i"), running.edges(df, "i"))
    for down in (False, True):
        order = [F.desc("v"), F.desc("i")] if down else [F.col("v"), F.col("i")]
        got = {r.i: (r.n, r.s) for r in running.running(df, ["k"], place, order, {"n": F.lit(1), "s": F.col("i")}, down).collect()}
        for k in (0, 1):
            total = 0
            for n, (_, _, i) in enumerate(sorted((d for d in data if d[0] == k), key=lambda d: d[1:], reverse=down), 1):
                total += i
                assert got[i] == (n, total)
    d = spark.createDataFrame([("a", float(i % 7), int(i % 3 == 0)) for i in range(90)], "name string, score double, positive int")
    r = metrics.detection_report(d, ["name"]).first()
    assert r.auroc == pytest.approx(plain_auroc([i % 7 for i in range(90)], [i % 3 == 0 for i in range(90)], [1] * 90))


def test_workers_import_the_package_from_anywhere(spark, tmp_path):
    """What ship() sends is the whole package: another Python, with nothing else on its path, imports all modules from it."""
    import os
    import subprocess
    import sys

    import evidra

    path, sent = evidra.packed(str(tmp_path)), []

    class Context:
        applicationId = "a test's"

        def addPyFile(self, file):
            sent.append(open(file, "rb").read())

    class Session:
        sparkContext = Context()

    evidra.ship(Session())
    evidra.ship(Session())
    assert sent == [open(path, "rb").read()] or len(sent) == 1
    code = f"""
import importlib, pkgutil, sys
sys.path.insert(0, {path!r})
import evidra
for m in pkgutil.walk_packages(evidra.__path__, "evidra."):
    if ".llm" not in m.name:
        importlib.import_module(m.name)
from evidra.operators import datasets
print("from", evidra.__file__)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert f"from {path}" in done.stdout, done.stderr[:3000]
