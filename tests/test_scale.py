"""What grows with the tables is shuffled and worked out once."""

import math
from collections import Counter

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from evidra.functions import draws
from evidra.functions.gating import BaselineThresholds, Thresholds
from evidra.operators import baselines, credibility, cuts, datasets, detection, experiments, fusion, metrics, ordered, resampling, running, tables, tuning
from evidra.operators.tables import kept
from evidra.plans import queries, views
from evidra.sources import runs


def lines(spark, folder, n=40):
    """Order lines of n orders as the views read them."""
    row = "id div 4 as l_orderkey, cast(id % 4 as int) as l_linenumber, cast(id % 50 as double) as l_quantity, cast(id % 11 as double) / 100 as l_discount, cast(id % 9 as double) / 100 as l_tax, id % 7 as l_suppkey"
    spark.range(4 * n).selectExpr(row.split(", ")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("levels", [1, 4])
def test_evidence_is_fused_where_its_lines_are_dealt(spark, tmp_path, levels):
    e = views.evidence(spark, lines(spark, tmp_path)).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    done = fusion.fuse_evaluators(fusion.fuse_documents(e, ["level", *fusion.GROUP]), ["level", *fusion.CLAIM])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert done.count() == 40 * levels


def test_fused_claims_meet_their_claims_where_they_are(spark, tmp_path):
    folder = lines(spark, tmp_path)
    orders = "id as o_orderkey, cast(id as int) as o_custkey"
    spark.range(50).selectExpr(*orders.split(", ")).write.parquet(f"{folder}/orders.parquet")
    done = fusion.run_pipeline(views.claims(spark, folder), views.evidence(spark, folder), Thresholds())
    # orders and lines are shuffled once each, fused claims aren't again
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = done.select("claim_id", "k_doc")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning") == 2
    assert sorted((r.claim_id, r.status) for r in done.collect()) == [(i, "normal" if i < 40 else "no_contexts") for i in range(50)]


def test_an_order_of_millions_of_rows_is_no_single_bucket(spark, tmp_path):
    """Estimates follow compressed files: these 6 million rows are about 25 MB."""
    spark.range(6_000_000).selectExpr("id order_key", "id % 7 = 0 correct").write.parquet(f"{tmp_path}/rows")
    assert running.is_large(spark.read.parquet(f"{tmp_path}/rows"))


def test_claims_and_documents_meet_once_for_their_numbers(spark, monkeypatch):
    monkeypatch.setattr(running, "ONE_BUCKET", -1)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    results = spark.range(300).selectExpr("id sample_id", "cast(id * 37 % 101 as double) k_doc", "case when id % 3 = 0 then 'conflicting' else 'supported' end gold_state")
    docs = spark.range(450).selectExpr("id % 300 sample_id", "id doc_id").mapInArrow(counted, "sample_id long, doc_id long")
    found = {r.documents: (r.n, r.auroc) for r in kept(detection.auroc_by_document_count(results, docs), "out").collect()}
    assert seen.value == 450
    for documents, inside in ((1, range(150, 300)), (2, range(150))):
        high, low = ([i * 37 % 101 for i in inside if (i % 3 == 0) == positive] for positive in (True, False))
        assert found[documents] == (150, pytest.approx(sum((a > b) + (a == b) / 2 for a in high for b in low) / len(high) / len(low)))
    one = docs.filter("doc_id < 300")
    assert detection.auroc_by_document_count(results, one).count() == 0


def test_large_inputs_of_an_order_are_worked_out_once(spark, monkeypatch):
    monkeypatch.setattr(running, "ONE_BUCKET", -1)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "name string, method string, score double, risk_score double, order_key long, positive int, correct int"
    row = "cast(id % 2 as string) name, 'm' method, cast(id % 17 as double) score, cast(id % 17 as double) risk_score, id order_key, cast(id % 3 = 0 as int) positive, cast(id % 3 = 0 as int) correct"
    df = spark.range(300).selectExpr(*row.split(", ")).mapInArrow(counted, schema)
    for work in (lambda: metrics.detection_report(df, ["name"]), lambda: metrics.risk_coverage(df, ["name"]), lambda: tuning.observed_grid(df, "score", 5, ["name"])):
        seen.value = 0
        kept(work(), "out")
        assert seen.value == 300


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_rows_of_an_order_are_shuffled_once_for_all_resamples(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ordered, "PART_ROWS", part_rows)
    score = "case when id % 3 = 0 then 5.0 when id % 5 = 0 then 2.0 else (id * 37) % 101 end"
    df = spark.range(400).selectExpr("cast(id % 2 as string) name", "id * 7919 id", f"cast({score} as double) score", f"cast({score} as double) risk_score", "id order_key", "cast(id % 7 < 3 as int) positive", "cast(id % 7 < 3 as int) correct")
    found = resampling.auroc_resamples(df, 9, 3), resampling.aurc_resamples(df, 9, 3)
    for made in found:  # no row is copied for each resample
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    copied = draws.resampled(df, ["id"], 9, 3)
    wanted = metrics.detection_report(copied, ["name", "resample"], times="w"), metrics.aurc(copied, ["name", "resample"], times="w")
    for made, want, value in zip(found, wanted, ("auroc", "aurc"), strict=True):
        a, b = ({(r["name"], r["resample"]): r[value] for r in x.collect()} for x in (made, want))
        assert a == pytest.approx(b) and len(a) == 20


def test_files_that_are_digested_whole_have_few_lines(spark, tmp_path, monkeypatch):
    from evidra.sources import files, writers

    monkeypatch.setattr(writers, "FILE_LINES", 10)
    for compression in ("none", "gzip"):
        at = f"{tmp_path}/{compression}"
        writers.write_jsonl(spark.range(0, 95, 1, 1), at, compression=compression)
        assert files.matching(spark, f"{at}/part-*") == 10 and files.artifact(spark, at)["records"] == 95


def test_baselines_read_the_evidence_once(spark, tmp_path):
    claims = spark.range(45).selectExpr("id sample_id", "id claim_id", "'supported' gold_state")
    done = baselines.run_baselines(claims, views.evidence(spark, lines(spark, tmp_path)), BaselineThresholds(), "e1")
    assert done._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["method"]: r["count"] for r in done.groupBy("method").count().collect()} == dict.fromkeys(("weighted_average", "majority_vote", "single_evaluator", "conflict_aware"), 45)


def test_relations_meet_nested_documents_in_one_shuffle(spark, tmp_path):
    d = lines(spark, tmp_path)
    one = F.struct("doc_id", "reliability", "pos")
    samples = views.contexts(spark, d).groupBy("sample_id").agg(F.array_sort(F.collect_list(one)).alias("contexts"))
    relations = views.evidence(spark, d).drop("pos", "doc_reliability").hint("merge")
    made = fusion.nested_evidence(relations, samples)
    fused = fusion.fuse_evaluators(fusion.fuse_documents(made))
    shuffles = [x for x in fused._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert shuffles and not any("evaluator" in x.split("hashpartitioning")[1].split("),")[0] for x in shuffles)
    wanted = fusion.join_evidence(relations, views.contexts(spark, d))
    key = ["claim_id", "doc_id", "evaluator", "doc_reliability"]
    assert sorted(made.select(key).collect()) == sorted(wanted.select(key).collect())
    with pytest.raises(Exception, match="unknown document"):
        fusion.nested_evidence(relations, samples.filter("sample_id <> 3")).collect()


def test_labels_are_weighed_without_a_copy_for_each_resample(spark):
    df = spark.range(300).selectExpr("id claim_id", "case when id % 5 > 0 then cast(id % 3 as string) end gold_state", "cast(id % 2 as string) predicted")
    made = resampling.label_counts(df, ["gold_state", "predicted"], ["claim_id"], 8, 3)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    wanted = draws.resampled(df, ["claim_id"], 8, 3).groupBy("gold_state", "predicted", "resample").agg(F.sum("w").alias("w"))
    a, b = (sorted(map(str, x.select("gold_state", "predicted", "resample", "w").collect())) for x in (made, wanted))
    assert a == b and len(a) == 8 * 9


def test_passages_are_weighed_without_a_row_for_each_term(spark, monkeypatch):
    monkeypatch.setattr(datasets, "PASSAGES", 3)
    text = lambda i: " ".join(f"w{i * k % 7}x" for k in range(1, 9)) + (" the" if i % 2 else "")
    texts = {(i % 3, i // 2, i % 2): None if i == 13 else text(i) for i in range(24)}
    asks = {0: "w1x w2x w2x the", 1: "w0x w5x", 2: "none"}
    rows = spark.createDataFrame([(*k, t) for k, t in texts.items()], "query_id long, doc_id long, passage int, text string").coalesce(1)
    asked = spark.createDataFrame(list(asks.items()), "query_id long, text string")
    made = datasets.best_passage(asked, rows)
    assert made._jdf.queryExecution().executedPlan().toString().count("Generate") == 1
    tf = lambda t: {w: 1 + math.log(n) for w, n in Counter(w for w in (t or "").split() if w != "the").items()}
    wanted = {}
    for q, ask in asks.items():
        own = {(d, p): tf(t) for (x, d, p), t in texts.items() if x == q}
        df = Counter(w for v in (*own.values(), tf(ask)) for w in v)
        idf = {w: math.log((2 + len(own)) / (1 + n)) + 1 for w, n in df.items()}
        for (d, p), v in sorted(own.items()):
            norm = math.sqrt(sum((x * idf[w]) ** 2 for w, x in v.items()))
            score = sum(x * idf[w] ** 2 * tf(ask).get(w, 0) for w, x in v.items()) / norm if norm else 0.0
            if (q, d) not in wanted or round(score, 9) > round(wanted[q, d][1], 9):
                wanted[q, d] = (p, score)
    found = {(r["query_id"], r["doc_id"]): (r["passage"], r["score"]) for r in made.collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in wanted.items()}
    assert {k: v[1] for k, v in found.items()} == pytest.approx({k: v[1] for k, v in wanted.items()})


def test_reliabilities_meet_evidence_by_its_sample(spark, tmp_path):
    e = views.evidence(spark, lines(spark, tmp_path)).hint("merge")
    known = e.filter("evaluator = 'e2' AND doc_id < 3").select("sample_id", "doc_id", (F.col("p_support") / 2).alias("reliability"))
    made = experiments.with_reliability(e, known)
    plan = fusion.fuse_evaluators(fusion.fuse_documents(made))._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert shuffles and not any("doc_id" in x.split("hashpartitioning")[1].split("),")[0] for x in shuffles)
    wanted = e.join(known, ["sample_id", "doc_id"], "left").withColumn("doc_reliability", F.coalesce("reliability", "doc_reliability"))
    key = ["claim_id", "doc_id", "evaluator", "doc_reliability"]
    assert sorted(made.select(key).collect()) == sorted(wanted.select(key).collect())


@pytest.mark.parametrize("one_bucket", [-1, 1 << 40])
def test_auroc_outside_of_folds_comes_from_one_count_of_scores(spark, monkeypatch, one_bucket):
    monkeypatch.setattr(running, "ONE_BUCKET", one_bucket)
    df = spark.range(300).selectExpr("cast(id % 2 as string) name", "cast(id * 7 % 3 as int) fold", "cast(case when id % 5 = 0 then 1 else id * 37 % 23 end as double) score", "cast(id % 11 < 4 as int) positive")
    df = df.unionByName(df.limit(3).selectExpr("'one' name", "1 fold", "score", "1 positive"))
    wanted = metrics.detection_report(df.withColumn("outer", F.explode(tuning.outside(df, 3))), ["outer", "name"]).select("outer", "name", "auroc")
    a, b = ({(r["outer"], r["name"]): r["auroc"] for r in x.collect()} for x in (metrics.auroc_outside(df, ["name"], 3), wanted))
    assert a.keys() == b.keys() and len(a) == 8
    assert {k: v for k, v in a.items() if v is not None} == pytest.approx({k: v for k, v in b.items() if v is not None})


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_auroc_without_resamples_needs_no_unit(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ordered, "PART_ROWS", part_rows)
    score = "cast(case when id % 3 = 0 then 5 when id % 5 = 0 then 2 else id * 37 % 101 end as double) score"
    df = spark.range(0, 400, 1, 3).selectExpr("cast(id % 2 as string) name", score, "cast(id % 7 < 3 as int) positive").unionByName(spark.sql("SELECT 'one' name, 1.0D score, 1 positive"))
    a, b = ({r["name"]: r["auroc"] for r in x.collect()} for x in (resampling.auroc_resamples(df, 0, 0, ["name"], []), metrics.detection_report(df, ["name"])))
    assert a.keys() == b.keys() and a["one"] is None and b["one"] is None
    assert [a["0"], a["1"]] == pytest.approx([b["0"], b["1"]])


def test_verdicts_are_read_for_their_counts_and_for_their_order(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    row = "cast(id % 2 as string) setting, 'ds' method, case when id % 3 = 0 then 'supported' else 'refuted' end gold_state, cast(id * 37 % 11 as double) margin, case when id % 5 = 0 then 'supported' else 'refuted' end predicted, false ds_undefined"
    df = spark.range(300).selectExpr(row.split(", ")).mapInArrow(counted, "setting string, method string, gold_state string, margin double, predicted string, ds_undefined boolean")
    kept(credibility.verdict_report(df, ["setting", "method"]), "out")
    assert seen.value == 600


def test_columns_that_variants_share_are_sorted_once(spark):
    columns = ["score_support", "score_refute", "conflict_sr_std", "conflict_max_product", "conflict_doc_count", "insufficiency_mean", "insufficiency_uprod"]
    stat = spark.range(90).selectExpr("'supported' gold_state", *(f"cast(id * {k + 3} % 41 as double) / 41 {c}" for k, c in enumerate(columns)))
    long = experiments.stat_methods(stat, ["gold_state"])
    assert long.count() == 540
    for side, most in (("m_theta", 2), ("k_doc", 3)):
        made, wanted = experiments.stat_grid(stat, side, 5), tuning.observed_grid(long, side, 5, ["method"])
        assert sorted(made.select(wanted.columns).collect()) == sorted(wanted.collect())
        assert len({str(r["value"]) + str(r["i"]) for r in made.collect()}) <= 5 * most


def test_calibrated_relations_meet_documents_by_their_sample(spark, monkeypatch):
    from evidra.plans import queries

    monkeypatch.delattr(fusion, "join_evidence")
    assert queries.calibrated_fusion(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("edges", [2, 16])
def test_thresholds_of_many_folds_come_from_counts(spark, monkeypatch, edges):
    """Grids, searches and labels of folds equal those of rows that are copied for each fold they aren't in."""
    monkeypatch.setattr(cuts, "EDGES", edges)
    gold, variants = "element_at(array('supported', 'refuted', 'insufficient', 'conflicting'), cast(id % 4 + 1 as int)) gold_state", ["sr_std", "doc_count_uprod"]
    columns = ["score_support", "score_refute", "conflict_sr_std", "conflict_doc_count", "insufficiency_mean", "insufficiency_uprod"]
    seen = spark.range(240).selectExpr("id sample_id", "id claim_id", gold, "array(cast(id * 7 % 3 as int), cast(id * 11 % 5 % 3 + 3 as int)) fold", *(f"if(id % 17 = {k}, null, round(cast(id * {k + 3} % 41 as double) / 41, 9)) {c}" for k, c in enumerate(("m_support", "m_refute", "m_theta"))), "if(id % 2 = 0, 0.0, id * 13 % 97 / 97D) k_doc")
    stat = spark.range(240).selectExpr("id sample_id", "id claim_id", gold, *(f"if(id % 3 = {k % 3}, 0.25, cast(id * {k + 5} % 53 as double) / 53) {c}" for k, c in enumerate(columns)))
    wide, long = (kept(make(seen, stat, variants), "rows") for make in (experiments.gate_scores, experiments.gate_methods))
    assert wide.count() == 240 and long.count() == 720
    rows = [r for r in long.collect() if r.m_theta is not None]
    grid = {(r.method, r.outer, r.i): r.value for r in tuning.inner_grid(long, "m_theta", 5, ["method"], 6).collect()}
    for m in experiments.gate_columns(variants):
        for f in range(6):
            v, first = sorted(r.m_theta for r in rows if r.method == m and f not in r.fold), {}
            for i in range(5):
                first.setdefault(round(v[round(i / 4 * (len(v) - 1))], 6), i)
            assert {i: x for (a, b, i), x in grid.items() if (a, b) == (m, f)} == {i: x for x, i in first.items()}
    copied = long.withColumn("outer", F.explode(tuning.outside(long, 6)))
    thetas, conflicts = (tuning.inner_grid(long, c, 5, ["method"], 6) for c in ("m_theta", "k_doc"))
    wanted = tuning.search_observed(copied, thetas, conflicts, ["method", "outer"]).select("method", "outer", "theta", "conflict", F.round("macro_f1", 9))
    made = tuning.search_observed(long, thetas, conflicts, ["method"], 6).select("method", "outer", "theta", "conflict", F.round("macro_f1", 9))
    assert sorted(made.collect()) == sorted(wanted.collect()) and made.count() == 18
    judged = experiments._gated(experiments._by_fold(long).join(experiments.tune_gates(long, 6, 5), ["method", "fold"])).groupBy("method", "fold", "gold_state", "predicted").count()
    counts = experiments.judged_gates(wide, 6, 5, variants)
    assert sorted(counts.select(*judged.columns[:4], "n").collect()) == sorted(judged.collect())


def test_selective_answers_take_all_resamples(spark, tmp_path):
    folder = lines(spark, tmp_path)
    spark.range(50).selectExpr("id as o_orderkey").write.parquet(f"{folder}/orders.parquet")
    found = queries.paired_selective_bootstrap(spark, folder).collect()
    assert {r.metric: r.n_resamples for r in found} == {"auroc": 2000, "aurc": 2000}
    assert queries.ORACLE_SQL["paired_selective_bootstrap"].count("range(-1, 2000)") == 1


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_both_metrics_of_selective_answers_come_from_one_order(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ordered, "PART_ROWS", part_rows)
    score = "case when id % 3 = 0 then 5.0 when id % 5 = 0 then 2.0 else (id * 37) % 101 end"
    df = spark.range(400).selectExpr("cast(id % 2 as string) name", "id * 7919 id", f"cast({score} as double) risk_score", "id order_key", "cast(id % 7 < 3 as int) correct")
    aurocs, risks = ordered.selective_by_resample(df, metrics.coverages(), 9, 3, ["name"], ["id"])
    wanted = resampling.auroc_resamples(df.selectExpr("name", "id", "risk_score score", "1 - correct positive"), 9, 3)
    assert {(r["name"], r["resample"]): r["auroc"] for r in aurocs.collect()} == pytest.approx({(r["name"], r["resample"]): r["auroc"] for r in wanted.collect()})
    assert risks.count() == 2 * 10 * 26


def test_documents_are_looked_up_by_place(spark):
    samples = spark.createDataFrame([("a", [("d1", 0.5), ("d2", 0.6)]), ("b", [("d1", 0.7), ("d1", 0.8)])], "sample_id string, contexts array<struct<doc_id:string,reliability:double>>")
    relations = spark.createDataFrame([("a", "d2"), ("a", "d1"), ("b", "d1")], "sample_id string, doc_id string")
    found = fusion.nested_evidence(relations, samples)
    assert sorted(found.collect()) == [("a", "d1", 0, 0.5), ("a", "d2", 1, 0.6), ("b", "d1", 0, 0.7), ("b", "d1", 1, 0.8)]
    assert "array_position" in found._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="unknown document: a/d3"):
        fusion.nested_evidence(spark.createDataFrame([("a", "d3")], "sample_id string, doc_id string"), samples).collect()
    with pytest.raises(Exception, match="unknown document: c/d1"):
        fusion.nested_evidence(spark.createDataFrame([("c", "d1")], "sample_id string, doc_id string"), samples).collect()


def test_runs_parse_samples_once(spark, tmp_path, monkeypatch):
    parsed = []
    monkeypatch.setattr(runs.readers, "read_samples", lambda spark, path: parsed.append(path) or spark.range(3).selectExpr("id sample_id"))
    monkeypatch.setattr(runs.readers, "read_relations", lambda spark, path: None)
    samples, _ = runs._inputs(spark, runs.Run({"samples": "s", "relation_predictions": "r"}, None, None, None, False, "none"))
    assert parsed == ["s"] and "samples" in samples.inputFiles()[0]


def test_kept_stages_are_compiled(spark):
    former, seen = spark.conf.get(tables.LIMIT), []
    write = DataFrameWriter.parquet
    with pytest.MonkeyPatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append(spark.conf.get(tables.LIMIT)) or write(self, path))
        assert kept(spark.range(3), "rows").count() == 3
    assert seen == ["8000"] and spark.conf.get(tables.LIMIT) == former


@pytest.mark.parametrize("estimator", ["auroc", "macro_f1"])
def test_estimated_reports_come_from_counts(spark, monkeypatch, estimator):
    """Without evidence copied for each outer fold: claims without documents, documents that repeat and null weights among them."""
    claims = spark.range(60).selectExpr("concat('s', id) sample_id", "concat('c', id) claim_id", "element_at(array('supported', 'refuted', 'insufficient', 'conflicting'), cast(id % 4 + 1 as int)) gold_state", "cast(id * 7 % 3 as int) fold")
    p = "(id * 13 % 11 + 1) a", "(id * 7 % 5 + doc * 3) b", "(id * 5 % 7 + 2) c"
    evidence = spark.range(57).selectExpr("*", "explode(sequence(0L, id % 4)) doc").selectExpr("*", "explode(array('e1', 'e2')) evaluator").selectExpr("*", *p).selectExpr(
        "concat('s', id) sample_id", "concat('c', id) claim_id", "concat('d', doc % 3) doc_id", "cast(doc as int) pos", "evaluator", "if(evaluator = 'e1', 0.9D, 0.7D) evaluator_reliability", "if(id % 9 = 0, 0D, 1 / (1 + doc)) doc_reliability",
        *(f"if(evaluator = 'e1', {x}, {y}) / (a + b + c) {n}" for x, y, n in (("a", "c", "p_support"), ("b", "a", "p_refute"), ("c", "b", "p_unknown"))))
    evidence, claims = kept(evidence, "evidence"), kept(claims, "claims")
    made = experiments.estimated_methods_report(claims, evidence, 3, 4, "e1", estimator)
    wanted = metrics.classification_report(experiments.estimated_methods_cv(claims, evidence, 3, 4, "e1", estimator), ["method"])
    a, b = ({r.method: (r.n, pytest.approx(r.accuracy), pytest.approx(r.macro_f1)) for r in x.collect()} for x in (made, wanted))
    assert a == {m: (n, acc.expected, f1.expected) for m, (n, acc, f1) in b.items()} and len(a) == 11
    rows = experiments.estimated_rows(claims, evidence, kept(experiments.estimates_by_fold(evidence, claims, 3, estimator).withColumnRenamed("fold", "outer"), "estimates"), 3, "e1")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("Window")  # above what groups the evidence
