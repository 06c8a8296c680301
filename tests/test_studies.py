"""Studies over folds, seeds, credibility and annotated relations, ingestion, inference and builds, on worked examples."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions.gating import Thresholds
from evidra.operators import baselines, builders, credibility, datasets, detection, experiments, fusion, inference, ingestion, judges, metrics, relations
from evidra.operators.tables import kept
from evidra.sources import builds, files, readers, writers

STATES = ["supported", "refuted", "insufficient", "conflicting"]
EVIDENCE = "sample_id string, claim_id string, doc_id string, pos int, evaluator string, evaluator_reliability double, doc_reliability double, p_support double, p_refute double, p_unknown double, credibility string"


def world(spark, n=60, seed=1):
    """Claims and evidence of two evaluators, of which the first one knows more."""
    rng, rows, claims = random.Random(seed), [], []
    for i in range(n):
        state = STATES[i % 4]
        claims.append((f"s{i}", f"c{i}", state))
        for d in range(rng.randint(1, 4)):
            for e, skill in (("e1", 3.0), ("e2", 0.3)):
                lean = {"supported": (1, 0, 0), "refuted": (0, 1, 0), "insufficient": (0, 0, 1), "conflicting": ((1, 0, 0) if d % 2 else (0, 1, 0))}[state]
                raw = [skill * x + rng.random() for x in lean]
                p = [x / sum(raw) for x in raw]
                rows.append((f"s{i}", f"c{i}", f"d{d}", d, e, 0.9 if e == "e1" else 0.7, [1.0, 0.6, 0.2][d % 3], *p, ["high", "low", "medium", None][(i + d) % 4]))
    return spark.createDataFrame(claims, "sample_id string, claim_id string, gold_state string"), spark.createDataFrame(rows, EVIDENCE)


def test_seeds_are_those_of_single_runs(spark):
    claims, evidence = world(spark)
    seeds, folds = [42, 7], 3
    stat = baselines.stat_gate_scores(claims, evidence)
    many = kept(experiments.seed_folds(claims, folds, seeds), "seeds")

    def parts(folded):
        gates = kept(experiments.gate_methods(fusion.run_pipeline(folded, evidence, Thresholds()), stat), "gates")
        return gates, kept(baselines.run_baselines(folded, evidence, experiments.BaselineThresholds(), "e1"), "scores")

    pooled, reports = experiments.seed_reports(*parts(many), folds, seeds, 4)
    pooled = kept(pooled, "pooled")
    got = {(r.seed, r.method): r.macro_f1 for r in reports.collect()}
    for seed in seeds:
        one = experiments.nested_cv_methods(*parts(kept(experiments.stratified_folds(claims, folds, seed), "folds")), folds, 4)
        for r in metrics.classification_report(one, ["method"]).collect():
            assert got[seed, r.method] == pytest.approx(r.macro_f1), (seed, r.method)
    robust = {r.method: r for r in experiments.seed_robustness(reports).collect()}
    two = [got[s, "majority_vote"] for s in seeds]
    r = robust["majority_vote"]
    assert (r.seeds, r.mean, r.deviation, r.low, r.high) == (2, pytest.approx(np.mean(two)), pytest.approx(np.std(two)), min(two), max(two))
    assert r.delta_mean == pytest.approx(np.mean([got[s, "ds"] - got[s, "majority_vote"] for s in seeds])) and robust["ds"].delta_high == 0
    found = experiments.seed_significance(pooled, resamples=30).collect()
    assert len(found) == 10 and all(x.seeds == 2 and 0 <= x.significant <= 2 for x in found)


def test_estimates_use_the_other_folds_alone(spark):
    claims, evidence = world(spark, 80)
    folded = kept(experiments.stratified_folds(claims, 4), "folds")
    rows, fold = evidence.collect(), {r.sample_id: (r.gold_state, r.fold) for r in folded.collect()}
    auroc = {(r.fold, r.evaluator): r for r in experiments.estimates_by_fold(evidence, folded, 4).collect()}
    macro = {(r.fold, r.evaluator): r for r in experiments.estimates_by_fold(evidence, folded, 4, "macro_f1").collect()}
    for o in range(4):
        for e in ("e1", "e2"):
            own: dict = {}
            for r in rows:
                if r.evaluator == e and fold[r.sample_id][1] != o:
                    own.setdefault(r.sample_id, []).append(r)
            mean = {s: [np.mean([getattr(r, c) for r in rs]) for c in ("p_support", "p_refute", "p_unknown")] for s, rs in own.items()}
            gold = {s: fold[s][0] for s in mean}
            rank = lambda pairs: np.mean([(a > b) + (a == b) / 2 for a, p in pairs if p for b, q in pairs if not q])
            one = rank([(m[0] - m[1], gold[s] == "supported") for s, m in mean.items() if gold[s] in ("supported", "refuted")])
            two = rank([(m[2], gold[s] == "insufficient") for s, m in mean.items()])
            assert auroc[o, e].reliability == pytest.approx(min(1, max(0, one + two - 1)), abs=1e-6)
            best = 0
            for k in range(15):
                said = {}
                for s, rs in own.items():
                    w = sum(r.doc_reliability for r in rs)
                    p = [round(sum(r.doc_reliability * getattr(r, c) for r in rs) / w, 9) for c in ("p_support", "p_refute", "p_unknown")]
                    said[s] = "insufficient" if max(p) < round(0.2 + 0.05 * k, 2) or p[2] == max(p) or sum(max(p) - x <= 1e-6 for x in p) > 1 else STATES[p.index(max(p))]
                f1 = [2 * sum(said[s] == gold[s] == c for s in gold) / max(1, sum(said[s] == c for s in gold) + sum(gold[s] == c for s in gold)) for c in STATES]
                best = max(best, np.mean(f1))
            assert macro[o, e].reliability == pytest.approx(max(0, (best - 0.25) / 0.75), abs=1e-6) and macro[o, e].skill == pytest.approx(best)
    assert all(auroc[o, "e1"].reliability > auroc[o, "e2"].reliability for o in range(4))


@pytest.mark.parametrize("estimator", ["auroc", "macro_f1"])
def test_estimated_methods_are_those_of_single_folds(spark, estimator):
    claims, evidence = world(spark)
    folded = kept(experiments.stratified_folds(claims, 3), "folds")
    pooled = kept(experiments.estimated_methods_cv(folded, evidence, 3, 4, "e1", estimator, ["sr_std"]), "pooled")
    got = {(r.method, r.claim_id): (r.fold, r.predicted) for r in pooled.collect()}
    assert len(got) == 6 * 60
    estimates = kept(experiments.estimates_by_fold(evidence, folded, 3, estimator), "estimates")
    for o in range(3):
        own = experiments.with_evaluator_reliability(evidence, estimates.filter(F.col("fold") == o), ["evaluator"])
        gates = kept(experiments.gate_methods(fusion.run_pipeline(folded, own, Thresholds()), baselines.stat_gate_scores(claims, own), ["sr_std"]), "gates")
        scores = kept(baselines.run_baselines(folded, own, experiments.BaselineThresholds(), "e1"), "scores")
        for r in experiments.nested_cv_methods(gates, scores, 3, 4).filter(F.col("fold") == o).collect():
            assert got[r.method, r.claim_id] == (o, r.predicted), (r.method, r.claim_id)
    if estimator == "auroc":
        alone = {r.claim_id: r.predicted for r in experiments.estimated_cv(folded, evidence, 3, 4).collect()}
        assert alone == {c: p for (m, c), (_, p) in got.items() if m == "ds"}


def test_settings_are_those_of_separate_runs(spark):
    claims, evidence = world(spark, 40)
    settings = credibility.grid({"high": 1.0, "medium": 0.6}, [0.0, 0.4], [0.4, 1.0])
    got = {(r.setting, r.claim_id, r.evaluator): r for r in credibility.fuse_settings(evidence, settings).collect()}
    said = {(r.setting, r.method, r.claim_id): r.margin for r in credibility.verdicts(claims, evidence, settings).collect()}
    for name, setting in settings.items():
        own = evidence.withColumn("doc_reliability", sum((F.when(credibility._is(c), v).otherwise(0.0) for c, v in setting.items()), F.lit(0.0)))
        for r in fusion.fuse_documents(own).collect():
            g = got[name, r.claim_id, r.evaluator]
            assert (g.m_support, g.m_refute, g.m_theta, g.k_doc, g.n_docs) == pytest.approx((r.m_support, r.m_refute, r.m_theta, r.k_doc, r.n_docs), abs=1e-12)
        for r in experiments.verdict_scores(claims, own).collect():
            assert said[name, r.method, r.claim_id] == pytest.approx(r.margin, abs=1e-9)
    with pytest.raises(Exception, match="no reliability for credibility other"):
        credibility.fuse_settings(evidence.withColumn("credibility", F.lit("other")), settings).collect()
    with pytest.raises(ValueError):
        credibility.fuse_settings(evidence, {"a": {"high": 1.0}, "b": {"low": 1.0}})
    rows = kept(credibility.verdicts(claims.filter(F.col("gold_state").isin("supported", "refuted")), evidence, settings), "verdicts")
    a, b = "low=0.4,unrated=1.0", "low=0.0,unrated=0.4"
    report = {(r.setting, r.method): r for r in credibility.verdict_report(rows, ["setting", "method"]).collect()}
    found = {(r.a, r.b, r.metric): r for r in credibility.compare_verdicts(rows, [((a, "ds"), (b, "weighted_average"))], 20).collect()}
    r = found[f"ds@{a}", f"weighted_average@{b}", "macro_f1"]
    assert r.delta == pytest.approx(report[a, "ds"].macro_f1 - report[b, "weighted_average"].macro_f1) and r.low <= r.high and r.n_resamples == 20
    assert found[f"ds@{a}", f"weighted_average@{b}", "auroc"].value_reference == pytest.approx(report[a, "ds"].auroc)


def test_sweeps_report_labels(spark):
    claims, evidence = world(spark, 40)
    contexts = evidence.select("sample_id", "doc_id", F.col("doc_reliability").alias("reliability")).distinct()
    known = contexts.filter("doc_id = 'd0'").withColumn("reliability", F.lit(0.5))
    points = {r.setting: r for r in experiments.reliability_sensitivity(claims, evidence, contexts, [0.3, 1.0], known, Thresholds(0.3, 0.3)).collect()}
    assert set(points) == {"0.3", "1.0", "oracle"} and points["1.0"].delta == 0 and points["oracle"].is_oracle and not points["0.3"].is_oracle
    for setting, own in (("0.3", evidence.withColumn("doc_reliability", F.lit(0.3))), ("oracle", experiments.with_reliability(evidence, known))):
        done = fusion.run_pipeline(claims, own, Thresholds(0.3, 0.3)).withColumn("predicted", F.coalesce("primary_state", F.lit("undetermined"))).withColumn("one", F.lit(1))
        r, p = metrics.classification_report(done, ["one"]).first(), points[setting]
        assert (p.accuracy, p.macro_f1, p.delta) == pytest.approx((r.accuracy, r.macro_f1, r.macro_f1 - points["1.0"].macro_f1))
        assert p.mean_theta == pytest.approx(done.agg(F.avg("m_theta")).first()[0])
    mean = np.mean([0.5 if r.doc_id == "d0" else r.reliability for r in contexts.collect()])
    assert points["oracle"].mean_reliability == pytest.approx(mean)
    for levels in ([0.5], [1.0, 1.5]):
        with pytest.raises(ValueError):
            experiments.reliability_sweep(claims, evidence, levels, Thresholds())


def test_relations_are_compared_on_the_same_pairs(spark):
    _, evidence = world(spark, 40)
    pair = ["sample_id", "claim_id", "doc_id", "p_support", "p_refute", "p_unknown"]
    good, poor = (evidence.filter(F.col("evaluator") == e).select(*pair) for e in ("e1", "e2"))
    best = good.withColumns({f"p_{k}": F.when(F.greatest("p_support", "p_refute", "p_unknown") == F.col(f"p_{k}"), 1.0).otherwise(0.0) for k in relations.RELATIONS})
    tied = best.filter("claim_id <> 'c0'").unionByName(best.filter("claim_id = 'c0'").withColumns({"p_support": F.lit(0.5), "p_refute": F.lit(0.5), "p_unknown": F.lit(0.0)}))
    found = {r.metric: r for r in relations.relation_comparison(tied, good, poor, 40).collect()}
    assert set(found) == {"accuracy", "macro_f1", "auroc_support", "auroc_refute", "auroc_unknown"}
    assert found["accuracy"].value_reference == 1.0 and found["accuracy"].low > 0 and found["accuracy"].p_value == 0 and found["auroc_support"].n_resamples == 40
    n = {(r.input, r.relation): r.n for r in relations.relation_counts(tied, good, poor).collect()}
    total, left = evidence.count() // 2, tied.filter("claim_id <> 'c0'").count()
    assert n["agreement", "agree"] + n["agreement", "differ"] == total and sum(v for (i, _), v in n.items() if i == "oracle") == left
    with pytest.raises(Exception, match="same pairs: s3/c3/d0, oracle 1, reference 0, rival 1"):
        relations.relation_counts(tied, good.filter("NOT (claim_id = 'c3' AND doc_id = 'd0')"), poor).collect()
    bad = relations.pair_violations(tied, good.unionByName(good.filter("claim_id = 'c1'")), poor).collect()
    assert {(r.claim_id, r.n_reference) for r in bad} == {("c1", 2)}


def test_clusters_are_drawn_whole(spark):
    from evidra.functions import draws

    rows = spark.createDataFrame([("s", f"c{i % 5}", f"d{i}") for i in range(40)], "sample_id string, claim_id string, doc_id string")
    by = draws.resampled(rows, fusion.CLAIM, 10).groupBy("claim_id", "resample").agg(F.count_distinct("w").alias("k"))
    assert by.filter("k > 1").count() == 0 and draws.resampled(rows, ["doc_id"], 10).groupBy("claim_id", "resample").agg(F.count_distinct("w").alias("k")).filter("k > 1").count() > 0


def test_proxies_are_compared_with_fusion(spark):
    claims, evidence = world(spark, 80)
    results, scores = kept(fusion.run_pipeline(claims, evidence, Thresholds()), "results"), kept(baselines.stat_gate_scores(claims, evidence), "scores")
    found = detection.compare_detection(results, scores, 20).collect()
    assert sorted((r.task, r.rival) for r in found) == sorted((t, n) for t, of in detection.proxies().items() for n in of) and len(found) == 10
    plain = {(r.task, r.name): r.auroc for r in metrics.detection_report(detection.fused_rows(results).unionByName(detection.proxy_rows(scores)), ["task", "name"]).collect()}
    assert all(r.delta == pytest.approx(plain[r.task, "ds"] - plain[r.task, r.rival]) for r in found)
    contexts = evidence.select("sample_id", "doc_id").distinct()
    few = detection.auroc_by_document_count(results, contexts, 10, 2).collect()
    assert few and all(r.n >= 10 for r in few)
    assert detection.auroc_by_document_count(results, contexts.filter("doc_id = 'd0'"), 1, 1).count() == 0


RESULT = "query_id string, doc_ids array<string>, labels array<array<string>>, probabilities array<array<array<double>>>"


def sample(name, docs, claims=1):
    return (name, "q", "a", None, [(f"{name}-c{k + 1}", "claim") for k in range(claims)], [(d, "text", None, 1.0) for d in docs], "supported")


def test_ingestion_sees_every_violation(spark):
    sane = [0.2, 0.3, 0.5]
    cases = {
        "good": (["a", "b"], [["Entailment", " neutral"], ["contradiction", "neutral"]], [[sane, sane], [[1.0, 0.0, 0.0], sane]]),
        "count": (["a"], [["neutral"]], [[sane]]), "order": (["b", "a"], [["neutral", "neutral"]], [[sane, sane]]), "none": (None, [["neutral", "neutral"]], [[sane, sane]]),
        "shape": (["a", "b"], [["neutral", "neutral"], ["neutral"]], [[sane, sane], [sane, sane]]), "long": (["a", "b"], [["neutral"] * 3], [[sane] * 3]),
        "lost": (["a", "b"], None, None), "empty": (["a", "b"], [], []), "label": (["a", "b"], [["neutral", "maybe"]], [[sane, sane]]), "null": (["a", "b"], [["neutral", None]], [[sane, sane]]),
        "range": (["a", "b"], [["neutral", "neutral"]], [[sane, [1.5, -0.5, 0.0]]]), "sum": (["a", "b"], [["neutral", "neutral"]], [[sane, [0.5, 0.5, 0.5]]]), "triple": (["a", "b"], [["neutral", "neutral"]], [[sane, [0.5, 0.5]]]),
        "several": (["a", "b"], [["neutral", "neutral"]], [[sane, sane], [sane, sane]]), "twice": (["a", "b"], [["neutral", "neutral"]], [[sane, sane]]), "claims": (["a", "b"], [["neutral", "neutral"]], [[sane, sane]]),
    }
    rows = [(k, *v) for k, v in cases.items()] + [("twice", *cases["twice"]), ("extra", *cases["good"]), (None, *cases["good"])]
    results = spark.createDataFrame(rows, RESULT)
    samples = spark.createDataFrame([sample(k, ["a", "b"], 2 if k == "claims" else 1) for k in cases] + [sample("missing", ["a", "b"])], readers.SAMPLE)
    found = sorted((r.query_id or "", r.kind) for r in ingestion.violations(results, samples).collect())
    assert found == sorted([
        ("", "no_query_id"), ("missing", "missing_result"), ("extra", "extra_result"), ("twice", "repeated_result"), ("twice", "repeated_result"), ("claims", "claim_count"), ("count", "document_count"), ("order", "document_order"), ("none", "no_documents"),
        ("none", "labels_shape"), ("none", "probabilities_shape"), ("shape", "labels_shape"), ("long", "labels_shape"), ("long", "probabilities_shape"), ("lost", "no_labels"), ("lost", "no_probabilities"), ("empty", "empty_labels"), ("empty", "empty_probabilities"),
        ("label", "unknown_label"), ("null", "unknown_label"), ("range", "probability_values"), ("triple", "probability_values"), ("sum", "probability_sum"), ("several", "other_claims"),
    ])
    assert ("good", "several_claims") in {(r.query_id, r.kind) for r in ingestion.violations(results, samples, single=True).collect()}
    only = samples.filter("sample_id = 'good'")
    good = ingestion.checked(results.filter("query_id = 'good'"), only)
    n = {r.doc_id: (r.n_entailment, r.n_neutral, r.n_contradiction) for r in ingestion.label_counts(good).collect()}
    assert n == {"a": (1, 0, 1), "b": (0, 2, 0)}
    p = {r.doc_id: (r.p_support, r.p_refute, r.p_unknown) for r in ingestion.probability_relations(good, "nli").collect()}
    assert p["a"] == pytest.approx((0.6, 0.25, 0.15)) and p["b"] == pytest.approx((0.2, 0.5, 0.3))
    for k in cases:
        if k != "good":
            with pytest.raises(Exception, match="checking results: "):
                ingestion.checked(results.filter(F.col("query_id") == k), samples.filter(F.col("sample_id") == k)).collect()
    with pytest.raises(Exception, match="missing_result"):
        ingestion.checked(results.filter("query_id = 'good'"), samples.filter("sample_id IN ('good', 'missing')")).collect()


def test_parts_of_ingestion_are_strict(spark):
    def one(labels=None, probabilities=None):
        return spark.createDataFrame([("q", ["a", "b"], labels, probabilities)], RESULT)

    for labels in (None, [], [["neutral"]], [["neutral"] * 3]):
        with pytest.raises(Exception, match="labels aren't"):
            datasets.checking_labels(one(labels)).collect()
    for p in (None, [], [[[0.2, 0.3, 0.5]]], [[[1.5, -0.5, 0.0], [0.2, 0.3, 0.5]]], [[[0.5, 0.5], [0.2, 0.3, 0.5]]]):
        with pytest.raises(Exception, match="probabilities aren't"):
            datasets.checking_probabilities(one(None, p)).collect()
    counts = spark.createDataFrame([("q", "a", 0, 0, 0)], "query_id string, doc_id string, n_entailment long, n_neutral long, n_contradiction long")
    with pytest.raises(Exception, match="no label for q/a"):
        builders.relations_from_counts(counts, dict.fromkeys(builders.CHECK_LABELS, (1, 0, 0)), "m").collect()
    own = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("r", "a", 0)], "sample_id string, doc_id string, pos int")
    with pytest.raises(Exception, match="no result for r"):
        builders.aligned(one([["neutral", "neutral"]]), own).collect()
    with pytest.raises(Exception, match="unknown document: s/x"):
        relation = spark.createDataFrame([("s", "x")], "sample_id string, doc_id string")
        fusion.join_evidence(relation, own.withColumn("reliability", F.lit(1.0))).collect()


def stub(folder, most=2, dies=False):
    """A model whose answer parses for pair d1 from its third attempt on, never for d2, and at once for others; dies: at d3."""

    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            out = []
            for s, c, d in zip(*(batch.column(k).to_pylist() for k in ("sample_id", "claim_id", "doc_id")), strict=True):
                if dies and d == "d3":
                    raise RuntimeError("the box went down")
                path = os.path.join(folder, f"{s}-{d}")
                asked = len(open(path).read()) if os.path.exists(path) else 0
                open(path, "a").write("x")
                ok = d not in ("d1", "d2") or (d == "d1" and asked >= most)
                text = json.dumps({"support": 0.6, "refute": 0.3, "unknown": 0.3}) if ok else ("" if asked else "sorry")
                out.append((s, c, d, text, None, "m-1", 10, 2))
            yield pa.RecordBatch.from_pylist([dict(zip(("sample_id", "claim_id", "doc_id", "answer", "error", "served_model", "input_tokens", "output_tokens"), r, strict=True)) for r in out], pa.schema([(k, pa.string()) for k in ("sample_id", "claim_id", "doc_id", "answer", "error", "served_model")] + [("input_tokens", pa.int64()), ("output_tokens", pa.int64())])) if out else batch

    return run


def test_inference_goes_on_after_a_crash(spark, tmp_path):
    seen, at = tmp_path / "seen", f"file://{tmp_path}/run"
    seen.mkdir()
    pairs = spark.createDataFrame([("s", "c", f"d{i}", "claim", "text") for i in range(6)], "sample_id string, claim_id string, doc_id string, claim_text string, doc_text string")
    with pytest.raises(Exception, match="the box went down"):
        inference.run_rounds(pairs, stub(str(seen), dies=True), at, "m", "digest")
    assert inference.answers(spark, at) is None or inference.answers(spark, at).count() == 0
    before = {p.name: len(p.read_text()) for p in seen.iterdir()}
    # one whole round is kept, then the box goes down again
    inference.run_rounds(pairs.filter("doc_id = 'd0'"), stub(str(seen)), at, "m", "digest")
    with pytest.raises(Exception, match="the box went down"):
        inference.run_rounds(pairs, stub(str(seen), dies=True), at, "m", "digest")
    assert inference.answers(spark, at).count() == 1
    for p in seen.iterdir():
        if p.name in ("s-d1", "s-d2"):
            p.write_text("")
    done = {r.doc_id: r for r in inference.run_rounds(pairs, stub(str(seen)), at, "m", "digest").collect()}
    assert (done["d0"].attempts, done["d1"].attempts, done["d2"].attempts, done["d5"].attempts) == (1, 3, 3, 1)
    assert done["d1"].valid and not done["d2"].valid and "form asked for" in done["d2"].last_error
    assert len((seen / "s-d0").read_text()) == before.get("s-d0", 0) + 1  # asked once since
    count = inference.answers(spark, at).count()
    assert inference.run_rounds(pairs, stub(str(seen)), at, "m", "digest").filter("valid").count() == 5 and inference.answers(spark, at).count() == count
    for other in ({"name": "n"}, {"digest": "e"}, {"effort": "high"}):
        with pytest.raises(ValueError, match="another"):
            inference.run_rounds(pairs, stub(str(seen)), at, **({"name": "m", "digest": "digest"} | other))
    samples = spark.createDataFrame([("s", "q", "a", None, [("c", "claim")], [(f"d{i}", "t", None, 1.0) for i in (3, 1, 0)], "supported")], readers.SAMPLE)
    answers = inference.answers(spark, at)
    row = inference.assembled(samples, answers).first()
    assert row.doc_ids == ["d3", "d1", "d0"] and row.labels == [["Entailment"] * 3] and row.probabilities[0][1] == pytest.approx([0.5, 0.25, 0.25])
    assert ingestion.violations(inference.assembled(samples, answers), samples).count() == 0
    holes = samples.withColumn("contexts", F.transform("contexts", lambda c: c.withField("doc_id", F.lit("d2"))))
    with pytest.raises(Exception, match="no valid answer for s/c/d2"):
        inference.assembled(holes, answers).collect()
    assert inference.usage(answers).first().input_tokens == 10 * count


def test_judges_are_accounted_for(spark):
    claims = spark.createDataFrame([(f"s{i}", "c", STATES[i % 4]) for i in range(40)], "sample_id string, claim_id string, gold_state string")
    rows = [(f"s{i}", "c", STATES[i % 4] if i % 5 else "odd", i == 7, 10, 1) for i in range(36)]
    kind = "sample_id string, claim_id string, label string, refused boolean, input_tokens long, output_tokens long"
    judged = kept(judges.judged(claims, spark.createDataFrame(rows, kind)), "judged")
    by = {r.status: r for r in judges.accounts(judged).groupBy("status").agg(F.sum("claims").alias("n"), F.sum("refused").alias("refused"), F.sum("input_tokens").alias("tokens")).collect()}
    assert (by["missing"].n, by["invalid"].n, by["valid"].n, by["invalid"].refused, by["valid"].tokens) == (4, 9, 27, 1, 270)
    assert {r.observed for r in judges.report(judged, 20).collect()} == {1.0}
    run = claims.select(F.lit("m").alias("method"), "sample_id", "claim_id", F.lit("supported").alias("predicted"))
    r = {x.metric: x for x in judges.compare_with_run(judged, run, 50).collect()}["accuracy"]
    valid = judged.filter("status = 'valid'").collect()
    assert r.n_claims == 27 and r.difference == pytest.approx(1 - np.mean([x.gold_state == "supported" for x in valid])) and r.low > 0
    with pytest.raises(Exception, match="not one prediction"):
        judges.compare_with_run(judged, run.filter("sample_id <> 's1'"), 5).collect()
    for more, said in ((("s1", "c", "refuted", False, 1, 1), "two answers"), (("x", "c", "refuted", False, 1, 1), "no claim")):
        with pytest.raises(Exception, match=said):
            judges.judged(claims, spark.createDataFrame([*rows, more], kind)).collect()


def test_builds_appear_at_once(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/set"
    lines = [{"claim_id": str(i), "claim": f"Claim number {i}", "claim_label": "SUPPORTS" if i % 2 else "REFUTES", "evidences": [{"evidence_id": "e", "evidence_label": "REFUTES", "article": "x", "evidence": f"t{i}", "entropy": 0.5, "votes": ["SUPPORTS", "REFUTES"]}]} for i in range(20)]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, lines)))
    keep = lambda df: kept(df, "drawn")
    build = lambda counts, **k: builds.build_votes(spark, f"file://{tmp_path}/f.jsonl", at, counts, "votes", keep=keep, **k)
    first = build({"train": 3, "test": 2}, homepage="h")
    assert first["splits"]["train"]["samples"]["records"] == 6 and first["splits"]["test"]["label_counts"] == {"refuted": 2, "supported": 2} and first["source"]["homepage"] == "h"
    assert builds.read_build(spark, at, "train").count() == 6 and builds.read_build(spark, at, "test", "relation_predictions").first().p_support == 0.5 and builds.read_build(spark, at, "test", "provenance").count() == 4
    with pytest.raises(FileExistsError):
        build({"train": 1})
    # a build that dies between two tables leaves the former version as it was
    write = writers.write_relations

    def dies(df, path, overwrite=False):
        if "test_relation" in path:
            raise RuntimeError("killed")
        write(df, path, overwrite)

    monkeypatch.setattr(writers, "write_relations", dies)
    with pytest.raises(RuntimeError):
        build({"train": 4, "test": 2}, overwrite=True)
    assert files.read_mapping(spark, f"{at}/manifest.json") == first and builds.read_build(spark, at, "train").count() == 6
    monkeypatch.setattr(writers, "write_relations", write)
    # and so does one that dies while it puts the manifest in place
    monkeypatch.setattr(files, "_replace", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        build({"train": 4, "test": 2}, overwrite=True)
    assert files.read_mapping(spark, f"{at}/manifest.json") == first and not [p for p in (tmp_path / "set").iterdir() if p.name.startswith("manifest.json.")]
    monkeypatch.undo()
    second = build({"train": 4, "test": 2}, overwrite=True)
    assert second["version"] != first["version"] and builds.read_build(spark, at, "train").count() == 8
    assert builds.prune(spark, at) == 3 and builds.read_build(spark, at, "train").count() == 8
    part = next(p for p in (tmp_path / "set" / second["version"] / "train_samples").iterdir() if p.name.endswith(".json"))
    part.with_name(f".{part.name}.crc").unlink()
    part.write_text(part.read_text().replace("Claim", "Other"))
    with pytest.raises(ValueError, match="manifest"):
        builds.read_build(spark, at, "train")


def test_other_builds(spark, tmp_path):
    qa = [{"claim": f"claim {i}", "label": ["Supported", "Refuted"][i % 2], "questions": [{"question": "Why?", "answers": [{"answer": "Yes", "answer_type": "Boolean", "boolean_explanation": "so", "source_url": "u", "source_medium": "m"}]}]} for i in range(8)]
    (tmp_path / "train.json").write_text(json.dumps(qa))
    (tmp_path / "dev.json").write_text(json.dumps([qa[0] | {"label": "Refuted"}, {"claim": " ", "label": "Refuted", "questions": []}]))
    at = f"file://{tmp_path}/qa"
    m = builds.build_questions(spark, {k: f"file://{tmp_path}/{k}.json" for k in ("train", "dev")}, at, {"train": 2, "test": 1}, "qa", keep=lambda df: kept(df, "drawn"))
    assert m["relation_predictions_kind"] == "none" and m["source"]["raw_records"] == 9 and builds.read_build(spark, at, "train").count() == 4
    assert all(r.sample_id.startswith("averitec-train") for r in builds.read_build(spark, at, "test").collect())
    with pytest.raises(ValueError, match="no relation"):
        builds.read_build(spark, at, "train", "relation_predictions")
    claims = spark.createDataFrame([("w1", "green apples fall", "supported"), ("w2", "zebra", "refuted")], "sample_id string, text string, gold_state string")
    pages = spark.createDataFrame([("w1", 1, "nothing here " * 5 + "green apples fall down", "https://www.a.b.example/x")], "sample_id string, evidence_id int, content string, url string")
    media = spark.createDataFrame([("b.example", "high")], "domain string, credibility string")
    at = f"file://{tmp_path}/web"
    builds.build_web(spark, claims, pages, media, {"high": 0.9}, 0.4, at, "web", {"name": "pages"}, keep=lambda df: kept(df, "web"), size=6, stride=3)
    web = {r.sample_id: r for r in builds.read_build(spark, at, "all").collect()}
    assert web["w1"].contexts[0].reliability == 0.9 and "green apples" in web["w1"].contexts[0].text and web["w2"].contexts == [] and builds.read_build(spark, at, "all", "provenance").count() == 2


def test_grids_are_looked_at(spark):
    from evidra.operators import tuning

    grid = spark.createDataFrame([(0.2, 0.5), (0.4, 0.7), (0.6, 0.7)], "value double, macro_f1 double")
    seen = spark.createDataFrame([(0.7,), (0.9,)], "x double")
    r = tuning.grid_health(grid, grid.filter("value = 0.2").select("value"), seen, "x").first()
    assert (r.low, r.high, r.seen_low, r.seen_high, r.out_of_range, r.at_border, r.flat) == (0.2, 0.6, 0.7, 0.9, True, True, False)
    r = tuning.grid_health(grid.withColumn("macro_f1", F.lit(0.5)), grid.filter("value = 0.4").select("value"), seen.union(spark.createDataFrame([(0.3,)], "x double")), "x").first()
    assert (r.out_of_range, r.at_border, r.flat) == (False, False, True)
    claims, _ = world(spark, 8)
    with pytest.raises(Exception, match="no gold state: s3"):
        experiments.stratified_folds(claims.withColumn("gold_state", F.when(F.col("sample_id") != "s3", F.col("gold_state"))), 2).collect()
    assert kept(claims, "c").count() == 8
    from evidra.operators.tables import drop_kept

    assert drop_kept(spark) > 0 and drop_kept(spark) == 0
