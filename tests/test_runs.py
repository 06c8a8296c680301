"""Calibration of labels, discounts in turn, and runs that a configuration describes."""

import json

import pytest
from pyspark.sql import functions as F

from evidra.operators import calibration, fusion
from evidra.sources import files, readers, runs, writers

COUNTS = "sample_id string, claim_id string, doc_id string, n_entailment long, n_neutral long, n_contradiction long"
ORACLE = "sample_id string, claim_id string, doc_id string, evaluator string, p_support double, p_refute double, p_unknown double"


def _inputs(spark):
    counts = spark.createDataFrame([("s", "c", "d1", 2, 0, 0), ("s", "c", "d2", 1, 0, 1), ("s", "c", "d3", 0, 2, 2)], COUNTS)
    oracle = spark.createDataFrame([("s", "c", "d1", "human", 0.8, 0.0, 0.2), ("s", "c", "d2", "human", 0.5, 0.5, 0.0), ("s", "c", "d3", "human", 0.0, 0.6, 0.4), ("s", "c", "d4", "human", 1.0, 0.0, 0.0), ("s", "c", "d1", "other", 0.0, 1.0, 0.0)], ORACLE)
    return counts, oracle


def test_labels_mean_what_annotations_say(spark):
    counts, oracle = _inputs(spark)
    rows = {r["label"]: r for r in calibration.calibrate(counts, oracle, "validation", "human").collect()}
    e, n, c = (rows[k] for k in ("entailment", "neutral", "contradiction"))
    assert (e.p_support, e.p_refute, e.p_unknown) == pytest.approx(((0.8 + 0.25) / 1.5, 0.25 / 1.5, 0.2 / 1.5))
    assert (n.p_support, n.p_refute, n.p_unknown) == pytest.approx((0.0, 0.6, 0.4))
    assert (c.p_support, c.p_refute, c.p_unknown) == pytest.approx((0.25, (0.25 + 0.3), 0.2))
    assert (e.weight, e.majority_pairs, e.met_support, c.majority_pairs, e.pair_count, e.used_default) == (1.5, 1, 1, 0, 3, False)
    found = calibration.calibrated_relations(counts, calibration.calibrate(counts, oracle, "validation", "human"), "checker", 0.5).collect()
    assert all(abs(r.p_support + r.p_refute + r.p_unknown - 1) < 1e-12 and r.evaluator_reliability == 0.5 for r in found) and len(found) == 3


def test_calibration_is_strict(spark):
    counts, oracle = _inputs(spark)
    run = lambda c, o, **more: calibration.calibrate(c, o, "validation", "human", **more).collect()
    with pytest.raises(ValueError, match="validation"):
        calibration.calibrate(counts, oracle, "test")
    with pytest.raises(Exception, match="several annotations of s/c/d1"):
        run(counts, oracle.withColumn("evaluator", F.lit("human")))
    with pytest.raises(Exception, match="no annotation of s/c/d3"):
        run(counts, oracle.filter("doc_id <> 'd3'"))
    with pytest.raises(Exception, match="no label of s/c/d1"):
        run(counts.withColumn("n_entailment", F.when(F.col("doc_id") == "d1", F.lit(None).cast("long")).otherwise(F.col("n_entailment"))), oracle)
    with pytest.raises(Exception, match="no pair"):
        run(counts.limit(0), oracle, default=calibration.DEFAULT_MAPPING)
    first = counts.filter("doc_id = 'd1'")
    with pytest.raises(Exception, match="label never seen"):
        run(first, oracle)
    rows = {r["label"]: r for r in run(first, oracle, default=calibration.DEFAULT_MAPPING)}
    assert rows["neutral"].used_default and (rows["neutral"].p_unknown, rows["neutral"].weight, rows["entailment"].used_default) == (0.8, 0.0, False)
    twice = counts.unionByName(counts.filter("doc_id = 'd2'")).unionByName(spark.createDataFrame([("s", "c", "d9", 0, 0, None)], COUNTS))
    found = calibration.violations(twice, oracle).select("kind", "doc_id").collect()
    assert sorted(map(tuple, found)) == [("no_annotation", "d9"), ("no_label", "d9"), ("repeated_pair", "d2"), ("several_annotations", "d1")]


def test_discounts_in_turn_are_one(spark):
    rows = fusion.identified(spark.createDataFrame([(0.5, 0.3, 0.2), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)], "p_support double, p_refute double, p_unknown double"))
    twice = fusion.discount(fusion.discount(rows, F.lit(0.5)), F.lit(0.4)).collect()
    once = fusion.discount(rows, F.lit(0.2)).collect()
    for a, b in zip(twice, once, strict=True):
        assert [a[c] for c in ("m_support", "m_refute", "m_theta", "reliability_applied")] == pytest.approx([b[c] for c in ("m_support", "m_refute", "m_theta", "reliability_applied")])
    assert fusion.discount(rows, F.lit(0.0)).first().m_theta == 1.0
    with pytest.raises(Exception, match="no reliability"):
        fusion.discount(rows, F.lit(1.5)).collect()


SAMPLES = [("s1", "", "", None, [("c1", "first")], [("d1", "text", None, 1.0), ("d2", "more", None, 0.5)], "supported"), ("s2", "", "", None, [("c2", "second")], [], "insufficient")]


def _folder(spark, tmp_path, config):
    at = f"file://{tmp_path}"
    if not (tmp_path / "samples").exists():
        writers.write_samples(spark.createDataFrame(SAMPLES, readers.SAMPLE), f"{at}/samples")
        writers.write_relations(spark.createDataFrame([("s1", "c1", d, "nli", 0.6, 0.3, 0.1, 0.8) for d in ("d1", "d2")], readers.RELATION), f"{at}/relations")
    paths = {"samples": "samples", "relation_predictions": "relations", "output_jsonl": "out/a/results", "output_csv": "out/flat"}
    config = {"paths": paths | config.pop("paths", {})} | config
    (tmp_path / "run.yaml").write_text(json.dumps(config))
    return f"{at}/run.yaml"


def test_a_run_follows_its_configuration(spark, tmp_path):
    path = _folder(spark, tmp_path, {"diagnostics": {"theta_threshold": 0.9, "document_conflict_threshold": 0.05}})
    found = {r.claim_id: r for r in runs.run_pipeline(spark, path).collect()}
    assert (found["c1"].primary_state, found["c1"].claim_text, found["c2"].status) == ("conflicting", "first", "no_contexts")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/flat").columns == writers.PIPELINE_COLUMNS
    counted = {tuple(r) for r in fusion.summarise(runs.run_pipeline(spark, path, overwrite=True)).collect()}
    assert ("primary_state", "conflicting", 1) in counted
    assert ("status", "no_contexts", 1) in counted
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a", "flat"]
    base = _folder(spark, tmp_path, {"baseline": {"single_evaluator": "nli", "decision_threshold": 0.4}, "paths": {"output_jsonl": "b/results", "output_csv": "b/flat"}})
    rows = {(r.method, r.claim_id): r.state for r in runs.run_baselines(spark, base).collect()}
    assert len(rows) == 8 and rows[("weighted_average", "c1")] == "supported" and rows[("majority_vote", "c2")] == "insufficient"


def test_nothing_is_overwritten_unasked(spark, tmp_path, monkeypatch):
    path = _folder(spark, tmp_path, {})
    runs.run_pipeline(spark, path)
    read = lambda: spark.read.json(f"file://{tmp_path}/out/a/results").count()
    with pytest.raises(FileExistsError):
        runs.run_pipeline(spark, path)
    # a run that dies as it writes its second output leaves the first as it was, and nothing beside it
    before = (tmp_path / "out" / "a" / "results").stat().st_mtime_ns
    monkeypatch.setattr(writers, "write_pipeline_csv", lambda *_: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError, match="died"):
        runs.run_pipeline(spark, path, overwrite=True)
    assert read() == 2 and (tmp_path / "out" / "a" / "results").stat().st_mtime_ns == before
    assert [p.name for p in (tmp_path / "out" / "a").iterdir() if not p.name.startswith(".")] == ["results"]


@pytest.mark.parametrize(
    ("config", "said"),
    [
        ({"diagnostics": {"theta": 0.5}}, "no key"), ({"diagnostics": {"theta_threshold": 1.5}}, "within 0 and 1"), ({"diagnostics": {"tie_tolerance": True}}, "within 0 and 1"),
        ({"diagnostics": {"theta_threshold": float("nan")}}, "within 0 and 1"), ({"diagnostics": {"theta_threshold": "0.5"}}, "within 0 and 1"), ({"diagnostics": [1]}, "mapping"), ({"extra": {}}, "section"),
        ({"output": {"overwrite": "yes"}}, "true or false"), ({"paths": {"samples": "nowhere"}}, "input"), ({"paths": {"output_csv": "out/a/results"}}, "same"), ({"paths": {"samples": 3}}, "not a path"), ({"baseline": {}}, "section"),
    ],
)
def test_configurations_are_checked_first(spark, tmp_path, config, said):
    path = _folder(spark, tmp_path, config)
    with pytest.raises((ValueError, FileNotFoundError), match=said):
        runs.read_run(spark, path)
    assert not files.exists(spark, f"file://{tmp_path}/out")


def test_baselines_need_an_evaluator(spark, tmp_path):
    with pytest.raises(ValueError, match="single_evaluator"):
        runs.read_run(spark, _folder(spark, tmp_path, {"baseline": {}}), baseline=True)
    with pytest.raises(ValueError, match="no key"):
        runs.read_run(spark, _folder(spark, tmp_path, {"baseline": {"single_evaluator": "a", "theta_threshold": 0.1}}), baseline=True)
