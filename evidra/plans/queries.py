"""The registered queries, each with SQL for the same rows in plans/oracle.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.gating import BaselineThresholds, Thresholds, fused_confidence, metric_label
from evidra.operators import baselines, builders, calibration, credibility, datasets, detection, experiments, fusion, ingestion, integrity, judges, metrics, relations, resampling, tuning
from evidra.operators.tables import kept, shared_dir
from evidra.plans import oracle, oracle_studies, views
from evidra.plans.views import K_DOC, K_EVAL, THETA, TIE
from evidra.sources import builds, files, readers, runs, writers

GATES = Thresholds(THETA, K_DOC, K_EVAL, TIE)
BASE = BaselineThresholds(0.3537, 1e-6, 0.2531, 0.0913)
PLACES = 6


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles to a few digits: sums of doubles depend on the order of their terms."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _claims(spark, d):
    return views.claims(spark, d)


def _evidence(spark, d):
    return views.evidence(spark, d)


def _results(spark, d) -> DataFrame:
    return fusion.run_pipeline(_claims(spark, d), _evidence(spark, d), GATES)


def _labelled(spark, d) -> DataFrame:
    return _results(spark, d).withColumn("predicted", metric_label(F.col("primary_state")))


MASSES = ["m_support", "m_refute", "m_theta"]


def discount_projection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.masses(_evidence(spark, d)).select("claim_id", "doc_id", "evaluator", *MASSES))


def doc_fusion(spark, d):
    return rounded(fusion.fuse_documents(_evidence(spark, d)).select("claim_id", "evaluator", *MASSES, "k_doc", "n_docs"))


def k_doc_trace(spark, d):
    t = fusion.trace(_evidence(spark, d))
    return rounded(t.select("claim_id", "evaluator", F.size("steps").cast("long").alias("n_steps"), *MASSES, F.coalesce(F.try_element_at("steps", F.lit(1))["conflict"], F.lit(0.0)).alias("first_conflict")), 8)


def evaluator_fusion(spark, d):
    return rounded(fusion.fuse_evaluators(fusion.fuse_documents(_evidence(spark, d))).select("claim_id", *MASSES, "k_doc", "k_eval", "n_evaluators"))


def pipeline_diagnostics(spark, d):
    cols = ["claim_id", "status", *MASSES, "k_doc", "k_eval", "region", "verdict", "primary_state", "evidence_insufficient", "document_conflict", "evaluator_disagreement", "gold_state"]
    return rounded(_results(spark, d).select(*cols))


def many_document_fusion(spark, d):
    """Hundreds of documents a claim, beyond what products of doubles hold."""
    return rounded(fusion.fuse_documents(views.supplier_evidence(spark, d)).select("claim_id", *MASSES, "k_doc", "n_docs"))


def status_diagnostics(spark, d):
    """Claims of all statuses: normal, without contexts, and in total conflict of documents or of evaluators."""
    r = fusion.run_pipeline(_claims(spark, d), views.torn_evidence(spark, d), GATES)
    return rounded(r.select("claim_id", "status", *MASSES, "k_doc", "k_eval", "region", "verdict", "primary_state", "evidence_insufficient", "evaluator_disagreement"))


def pipeline_summary(spark, d):
    return fusion.summarise(_results(spark, d))


def selective_confidence(spark, d):
    df = _labelled(spark, d)
    return rounded(df.select("claim_id", "predicted", fused_confidence(F.col("predicted"), *map(F.col, MASSES), F.col("k_doc")).alias("confidence")))


def integrity_violations(spark, d):
    """Over the relations less every seventh document's second evaluator, with claims of order numbers by 11 unknown."""
    found = _evidence(spark, d).filter(~((F.col("evaluator") == "e2") & (F.col("claim_id") % 7 == 0) & (F.col("doc_id") == 1)))
    claims = _claims(spark, d).filter("claim_id % 11 <> 0")
    return integrity.violations(claims, views.contexts(spark, d), found)


def first_n_documents(spark, d):
    return integrity.first_documents(views.contexts(spark, d).select("sample_id", "doc_id", "pos"), 2).select("sample_id", "doc_id")


def _baseline(method):
    def run(spark, d):
        scores = {"weighted_average": baselines.weighted_scores, "conflict_aware": baselines.weighted_scores, "majority_vote": baselines.vote_scores, "single_evaluator": lambda e: baselines.single_scores(e, "e1")}[method]
        df = baselines.decide(_claims(spark, d), scores(_evidence(spark, d)), method, BASE)
        return rounded(df.select("claim_id", *baselines.SCORES, "state", "reason", "confidence", "input_count"))

    return run


def baseline_summary(spark, d):
    df = baselines.run_baselines(_claims(spark, d), _evidence(spark, d), BASE, "e1")
    return df.groupBy("method", "state", "reason").agg(F.count("*").alias("n"))


STAT = ["score_support", "score_refute", "score_unknown", "conflict_sr_std", "conflict_max_product", "conflict_doc_count", "insufficiency_mean", "insufficiency_uprod"]


def stat_gate_scores(spark, d):
    return rounded(baselines.stat_gate_scores(_claims(spark, d), _evidence(spark, d)).select("claim_id", *STAT))


def stat_gate_decisions(spark, d):
    df = baselines.stat_gate_decisions(baselines.stat_gate_scores(_claims(spark, d), _evidence(spark, d)), Thresholds(0.4137, 0.1713))
    return df.groupBy("method", F.coalesce("state", F.lit("undetermined")).alias("state")).agg(F.count("*").alias("n"))


def confusion_matrix(spark, d):
    return metrics.confusion(_labelled(spark, d), [])


def class_metrics(spark, d):
    return rounded(metrics.class_metrics(_labelled(spark, d), []).select("label", "support", "predicted", "tp", "precision", "recall", "f1"))


def classification_report(spark, d):
    return rounded(metrics.classification_report(_labelled(spark, d).withColumn("method", F.lit("ds")), ["method"]))


def detection_report(spark, d):
    return rounded(metrics.detection_report(detection.fused_rows(_results(spark, d)).withColumn("name", F.when(F.col("task") == "conflict", "k_doc").otherwise("m_theta")), ["name"]))


def detection_proxies(spark, d):
    """AUROC of the seven conflict and three insufficiency proxies."""
    rows = detection.proxy_rows(baselines.stat_gate_scores(_claims(spark, d), _evidence(spark, d)))
    return rounded(resampling.auroc_resamples(rows, 0, 0, ["name"], []).select("name", "auroc"))


def auroc_by_doc_count(spark, d):
    return rounded(detection.auroc_by_document_count(_results(spark, d), views.contexts(spark, d)))


def observed_grid(spark, d):
    return rounded(tuning.observed_grid(_results(spark, d).withColumn("m_theta", F.round("m_theta", 9)), "m_theta", 9).select(F.col("i").cast("long").alias("i"), "value"))


GRID = ([0.1531, 0.2371, 0.3313], [0.1917, 0.3137, 0.4519])


def ds_threshold_search(spark, d):
    df = _results(spark, d)
    return rounded(tuning.search_gates(df, tuning.gate_grid(*GRID, df), []).select("theta", "conflict", "accuracy", "macro_f1"))


def baseline_threshold_search(spark, d):
    """The reference's points: 15 decision thresholds for the weighted average."""
    df = baselines.decide(_claims(spark, d), baselines.weighted_scores(_evidence(spark, d)), "weighted_average", BASE)
    return rounded(tuning.search_decisions(df, []).select("decision", "macro_f1", "plateau"))


def grid_health(spark, d):
    """Whether the decision thresholds tried cover what was observed, and whether the best one lies inside them."""
    df = baselines.decide(_claims(spark, d), baselines.weighted_scores(_evidence(spark, d)), "weighted_average", BASE)
    tried = kept(tuning.decision_candidates(df, []).withColumnRenamed("decision", "value"), "tried")
    chosen = tuning.best_decisions(tried.withColumnRenamed("value", "decision"), []).withColumnRenamed("decision", "value")
    return rounded(tuning.grid_health(tried, chosen, df.withColumn("top_score", F.greatest(*baselines.SCORES)), "top_score"))


def conflict_aware_search(spark, d):
    """All triples of decision, conflict and margin thresholds."""
    df = baselines.decide(_claims(spark, d), baselines.weighted_scores(_evidence(spark, d)), "weighted_average", BASE)
    return rounded(tuning.search_decisions(df, [], True, margins=[0.05, 0.1, 0.2, 0.4]).select("decision", "conflict", "margin", "macro_f1", "accuracy", "plateau"))


def stat_gate_search(spark, d):
    """The best gates of each variant over observed values, nine a side."""
    stat = kept(_stat(spark, d), "stat")
    thetas, conflicts = (experiments.stat_grid(stat, c, 9) for c in ("m_theta", "k_doc"))
    return rounded(tuning.search_observed(experiments.stat_methods(stat, ["gold_state"]), thetas, conflicts, ["method"]).select("method", "theta", "conflict", "macro_f1"))


def ablation(spark, d):
    return rounded(experiments.ablation(_results(spark, d), GATES).drop("vacuous"))


def reliability_sweep(spark, d):
    return rounded(experiments.reliability_sweep(_claims(spark, d), _evidence(spark, d), [0.25, 0.5, 0.75, 1.0], GATES))


def verdict_scores(spark, d):
    return rounded(experiments.verdict_scores(_claims(spark, d), _evidence(spark, d)).groupBy("method", "label").agg(F.count("*").alias("n"), F.avg("margin").alias("mean_margin")))


def stratified_folds(spark, d):
    return experiments.stratified_folds(_claims(spark, d), 5).select("claim_id", F.col("fold").cast("long").alias("fold"))


FOLDS, STEPS = 5, 9


def _folded(spark, d, folds=FOLDS) -> DataFrame:
    df = experiments.stratified_folds(_results(spark, d), folds)
    return kept(df.withColumns({c: F.round(c, 9) for c in ("m_support", "m_refute", "m_theta", "k_doc")}), "folded")


def _stat(spark, d) -> DataFrame:
    return rounded(baselines.stat_gate_scores(_claims(spark, d), _evidence(spark, d)), 9)


def _gates(spark, d, folds=FOLDS) -> DataFrame:
    return kept(experiments.gate_methods(_folded(spark, d, folds), _stat(spark, d)), "gates")


def _baseline_scores(spark, d, folds=FOLDS) -> DataFrame:
    df = baselines.run_baselines(experiments.stratified_folds(_claims(spark, d), folds), _evidence(spark, d), BASE, "e1")
    return kept(df.withColumns({c: F.round(c, 9) for c in baselines.SCORES}), "baselines")


def nested_cv(spark, d):
    return rounded(metrics.classification_report(experiments.nested_cv(_folded(spark, d), FOLDS, STEPS), ["fold"]).select(F.col("fold").cast("long").alias("fold"), "accuracy", "macro_f1", "n"))


def nested_cv_methods(spark, d):
    """Fusion, six statistical gates and four baselines, each tuned within."""
    pooled = experiments.nested_cv_methods(_gates(spark, d), _baseline_scores(spark, d), FOLDS, STEPS)
    return rounded(metrics.classification_report(pooled, ["method"]))


def nested_cv_margins(spark, d):
    """The thresholds of the baselines in each fold where conflict_aware has three of its own."""
    chosen = experiments.tune_decisions(_baseline_scores(spark, d), FOLDS, [0.05, 0.1, 0.2])
    return rounded(chosen.select(F.col("fold").cast("long").alias("fold"), "method", "decision", "conflict", "margin"))


def nested_ablation(spark, d):
    return rounded(metrics.classification_report(experiments.nested_ablation(_folded(spark, d), FOLDS, STEPS), ["method"]))


def _long(spark, d) -> DataFrame:
    return experiments.baseline_long(_results(spark, d), baselines.run_baselines(_claims(spark, d), _evidence(spark, d), BASE, "e1"))


def baseline_long(spark, d):
    return rounded(_long(spark, d).drop("sample_id"))


def comparison_report(spark, d):
    """Every method's labels and detection scores side by side."""
    long = _long(spark, d).withColumns({c: F.round(c, 9) for c in ("conflict_score", "insufficiency_score")})
    return rounded(experiments.comparison_report(long))


def reliability_sensitivity(spark, d):
    """The sweep, and the documents' entropy of the second evaluator as their reliability."""
    e = _evidence(spark, d)
    p = [F.col(c) for c in ("p_support", "p_refute", "p_unknown")]
    known = e.filter("evaluator = 'e2'").select("sample_id", "doc_id", datasets.entropy_reliability(p).alias("reliability"))
    return rounded(experiments.reliability_sensitivity(_claims(spark, d), e, views.contexts(spark, d), [0.5, 1.0], known, GATES))


def _estimated_folds(estimator):
    def run(spark, d):
        folded = experiments.stratified_folds(_claims(spark, d), FOLDS)
        return rounded(experiments.estimates_by_fold(_evidence(spark, d), folded, FOLDS, estimator).select(F.col("fold").cast("long").alias("fold"), "evaluator", "reliability", "skill"))

    return run


def estimated_reliability_cv(spark, d):
    """nested_cv of fusion with estimated reliabilities."""
    folded = kept(experiments.stratified_folds(_claims(spark, d), FOLDS), "folds")
    return rounded(metrics.classification_report(experiments.estimated_cv(folded, _evidence(spark, d), FOLDS, STEPS), ["method"]))


def _estimated_methods(estimator):
    def run(spark, d):
        folded = kept(experiments.stratified_folds(_claims(spark, d), FOLDS), "folds")
        return rounded(experiments.estimated_methods_report(folded, _evidence(spark, d), FOLDS, 5, "e1", estimator))

    return run


SEEDS = [42, 1, 2, 3, 4]


def seed_robustness(spark, d):
    """nested_cv_methods under five seeds."""
    claims = kept(experiments.seed_folds(_claims(spark, d), FOLDS, SEEDS), "seeds")
    results = fusion.run_pipeline(claims, _evidence(spark, d), GATES)
    stat = baselines.stat_gate_scores(_claims(spark, d), _evidence(spark, d))
    gates = rounded(experiments.gate_scores(results, stat), 9)
    scores = baselines.run_baselines(claims, _evidence(spark, d), BASE, "e1").select("method", *fusion.CLAIM, "fold", "gold_state", *baselines.SCORES)
    reports = experiments.seed_report(kept(gates, "gates"), kept(rounded(scores, 9), "baselines"), FOLDS, SEEDS, 5)
    return rounded(experiments.seed_robustness(reports))


def _risk_rows(spark, d):
    df = _labelled(spark, d)
    sure = fused_confidence(F.col("predicted"), *map(F.col, MASSES), F.col("k_doc"))
    return df.select(F.lit("ds").alias("method"), F.round(1 - sure, 9).alias("risk_score"), F.col("claim_id").alias("order_key"), (F.col("predicted") == F.col("gold_state")).cast("int").alias("correct"))


def risk_coverage(spark, d):
    return rounded(metrics.risk_coverage(_risk_rows(spark, d), ["method"]))


def aurc(spark, d):
    return rounded(metrics.aurc(_risk_rows(spark, d), ["method"]))


#: Resamples of metrics of labels, of an order, and of selective answers (all that the study takes).
RESAMPLES, RANKED, SELECTIVE = 200, 50, 2000


def paired_bootstrap(spark, d):
    """Fusion against the weighted average on all claims."""
    ds = _labelled(spark, d).select("claim_id", "gold_state", F.col("predicted").alias("predicted_a"))
    wa = baselines.decide(_claims(spark, d), baselines.weighted_scores(_evidence(spark, d)), "weighted_average", BASE).select("claim_id", F.col("state").alias("predicted_b"))
    return rounded(resampling.paired_bootstrap(ds.join(wa, "claim_id"), RESAMPLES))


def bootstrap_interval(spark, d):
    return rounded(resampling.bootstrap_interval(_labelled(spark, d), RESAMPLES))


def paired_auroc_bootstrap(spark, d):
    """Fusion's conflict and ignorance against each proxy, on all claims."""
    stat = baselines.stat_gate_scores(_claims(spark, d), _evidence(spark, d))
    return rounded(detection.compare_detection(_results(spark, d), stat, RANKED))


def paired_selective_bootstrap(spark, d):
    """How well confidence ranks errors: fusion against the weighted average, on all claims."""
    long = _long(spark, d).filter("method IN ('ds', 'weighted_average')")
    rows = long.select(F.col("method").alias("name"), F.col("claim_id").alias("id"), F.round(1 - F.col("confidence"), 9).alias("risk_score"), F.col("claim_id").alias("order_key"), (F.col("predicted") == F.col("gold_state")).cast("int").alias("correct"))
    return rounded(resampling.paired_selective_bootstrap(rows, "ds", SELECTIVE))


def compare_runs(spark, d):
    """The baselines with this evidence against those with all documents at full reliability."""
    run = lambda e: baselines.run_baselines(_claims(spark, d), e, BASE, "e1").withColumnRenamed("state", "predicted")
    full = run(_evidence(spark, d).withColumn("doc_reliability", F.lit(1.0)))
    return rounded(resampling.compare_runs(kept(run(_evidence(spark, d)), "run"), kept(full, "run"), RESAMPLES))


def label_calibration(spark, d):
    """What the majority vote of the second evaluator means in the first one's probabilities."""
    from evidra.functions.gating import vote

    e = _evidence(spark, d)
    label = vote(F.col("p_support"), F.col("p_refute"), F.col("p_unknown"))
    judged = e.filter("evaluator = 'e2'").select("claim_id", "doc_id", label.alias("label"), F.col("doc_reliability").alias("weight"))
    return rounded(datasets.calibrate_labels(judged.join(e.filter("evaluator = 'e1'").select("claim_id", "doc_id", "p_support", "p_refute", "p_unknown"), ["claim_id", "doc_id"])))


def _three_inputs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Votes on each line as annotations, and both evaluators."""
    e = _evidence(spark, d)
    return views.voted_relations(spark, d), e.filter("evaluator = 'e1'"), e.filter("evaluator = 'e2'")


def relation_comparison(spark, d):
    """Which evaluator's relations are nearer to the annotated ones, resampled by claim."""
    return rounded(relations.relation_comparison(*_three_inputs(spark, d), RANKED))


def relation_counts(spark, d):
    return relations.relation_counts(*_three_inputs(spark, d))


def pair_violations(spark, d):
    """Over inputs of which one lacks each eleventh claim and another has every thirteenth twice."""
    oracle, first, second = _three_inputs(spark, d)
    twice = second.unionByName(second.filter("claim_id % 13 = 0"))
    return relations.pair_violations(oracle, first.filter("claim_id % 11 <> 0"), twice)


CREDIBILITY = {"high": 1.0, "medium": 0.6, "low": 0.2, None: 0.6}
SETTINGS = {"none": dict.fromkeys(CREDIBILITY, 1.0), "credibility": CREDIBILITY}
GRID12 = credibility.grid({"high": 1.0, "medium": 0.6}, [0.0, 0.2, 0.4], [0.4, 0.6, 0.8, 1.0])


def _verdicts(spark, d, settings, methods=credibility.METHODS) -> DataFrame:
    claims = _claims(spark, d).filter(F.col("gold_state").isin(credibility.VERDICTS))
    return kept(credibility.verdicts(claims, views.rated_evidence(spark, d), settings).filter(F.col("method").isin(*methods)), "verdicts")


def credibility_verdicts(spark, d):
    """Verdicts with and without the sources' credibility."""
    return rounded(credibility.verdict_report(_verdicts(spark, d, SETTINGS), ["setting", "method"]))


def credibility_comparison(spark, d):
    pairs = [(("credibility", "ds"), ("none", "ds")), (("credibility", "weighted_average"), ("none", "weighted_average")), (("credibility", "ds"), ("credibility", "weighted_average")), (("none", "ds"), ("none", "weighted_average")), (("credibility", "ds"), ("none", "majority_vote"))]
    return rounded(credibility.compare_verdicts(_verdicts(spark, d, SETTINGS), pairs, RANKED))


def credibility_grid(spark, d):
    """Twelve maps of credibility to reliability, fused in one aggregate."""
    rows = _verdicts(spark, d, GRID12, credibility.METHODS[:2])
    return rounded(credibility.verdict_report(rows, ["setting", "method"]).select("setting", "method", "accuracy", "macro_f1", "auroc"))


def vote_distribution(spark, d):
    """Line items as votes on their order: flags A, R and N support, refute and give no information."""
    kind = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "refutes").otherwise("not_enough_info")
    votes = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), kind.alias("vote"))
    return rounded(datasets.vote_distribution(votes, ["claim_id"]))


def entropy_reliability(spark, d):
    p = [F.col(c) for c in ("p_support", "p_refute", "p_unknown")]
    return rounded(_evidence(spark, d).select("claim_id", "doc_id", "evaluator", datasets.entropy_reliability(p).alias("reliability")))


def claim_dedup(spark, d):
    return datasets.dedup_first(views.table(spark, d, "documents"), "text", "doc_id").select("doc_id", "copies")


def passage_windows(spark, d):
    w = datasets.windows(views.table(spark, d, "documents"), "doc_id", "text")
    return w.select("doc_id", F.col("passage").cast("long").alias("passage"), F.col("start").cast("long").alias("start"), F.md5("text").alias("text_md5"))


def passage_tfidf_top1(spark, d):
    """Of each document the window nearest to its benchmark item. Documents are dealt to all items in the order of their
    ids: document k to the item at k modulo the number of items."""
    asked, items = datasets.numbered(views.table(spark, d, "benchmark").select("item_id", "text"), "item_id", "query_id")
    docs = datasets.windows(views.table(spark, d, "documents"), "doc_id", "text").withColumn("query_id", F.pmod("doc_id", F.lit(max(items, 1))))
    return rounded(datasets.best_passage(asked.select("query_id", "text"), docs.join(asked.select("query_id"), "query_id", "left_semi")).select("doc_id", F.col("passage").cast("long").alias("passage"), "score"))


def balanced_split(spark, d):
    """Documents by language: as many of each for training, validation and test."""
    docs = views.table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", "lang")
    return builders.balanced_split(docs, "text", "lang", F.col("doc_id"), {"train": 4, "validation": 2, "test": 3}).select("doc_id", "lang", "split")


def _voted(spark, d) -> DataFrame:
    """Orders as annotated claims: a line item is an evidence whose flag, if it is A or R, is its only vote."""
    flag = F.col("l_returnflag")
    label = F.when(F.col("l_linestatus") == "F", "SUPPORTS").otherwise("NOT_ENOUGH_INFO")
    votes = F.when(flag == "A", F.array(F.lit("SUPPORTS"), F.lit(None))).when(flag == "R", F.array(F.lit("REFUTES"), F.lit("SUPPORTS"), F.lit("REFUTES"))).otherwise(F.array(F.lit(None).cast("string")))
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", label.alias("evidence_label"), votes.alias("votes"))
    lines = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.array_sort(F.collect_list(one)).alias("evidences"))
    return lines.withColumns({"claim": F.concat(F.lit("claim "), "claim_id"), "claim_label": F.lit("DISPUTED")})


def vote_relations(spark, d):
    """Relations of votes; a line without one takes the evidence's label."""
    r = builders.vote_relations(_voted(spark, d))
    return rounded(r.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("p_support").alias("p_support"), F.sum("p_refute").alias("p_refute"), F.sum("p_unknown").alias("p_unknown")))


def _checked(spark, d) -> DataFrame:
    """Votes of both evaluators as labels of two sub-claims of each pair, nested as a checking model returns them."""
    from evidra.functions.gating import vote

    v = vote(F.col("p_support"), F.col("p_refute"), F.col("p_unknown"))
    label = F.when(v == "supported", " Entailment").when(v == "refuted", "contradiction").otherwise("Neutral ")
    row = _evidence(spark, d).groupBy("claim_id", "evaluator").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", label.alias("label")))).alias("x"))
    row = row.select("claim_id", "evaluator", F.transform("x", lambda c: c["doc_id"].cast("string")).alias("doc_ids"), F.transform("x", lambda c: c["label"]).alias("labels"))
    return row.groupBy(F.col("claim_id").alias("query_id")).agg(F.first("doc_ids").alias("doc_ids"), F.transform(F.array_sort(F.collect_list(F.struct("evaluator", "labels"))), lambda c: c["labels"]).alias("labels"))


def relations_from_labels(spark, d):
    """Labels of a checking model as relations."""
    own = views.contexts(spark, d).select("sample_id", F.col("doc_id").cast("string").alias("doc_id"), "pos")
    counts = datasets.checking_labels(builders.aligned(_checked(spark, d), own)).groupBy("query_id", "doc_id").agg(*(F.sum(f"n_{k}").alias(f"n_{k}") for k in builders.CHECK_LABELS))
    mapping = {"entailment": (0.85, 0.05, 0.1), "neutral": (0.1, 0.1, 0.8), "contradiction": (0.05, 0.85, 0.1)}
    return rounded(builders.relations_from_counts(counts, mapping, "checker").drop("evaluator_reliability"))


def label_contingency(spark, d):
    """What the second evaluator's vote meets in the first one's largest probability."""
    from evidra.functions.gating import vote

    e = _evidence(spark, d)
    v = vote(F.col("p_support"), F.col("p_refute"), F.col("p_unknown"))
    judged = e.filter("evaluator = 'e2'").select("claim_id", "doc_id", v.alias("label")).join(e.filter("evaluator = 'e1'").select("claim_id", "doc_id", "p_support", "p_refute", "p_unknown"), ["claim_id", "doc_id"])
    return builders.contingency(judged)


def url_domain(spark, d):
    return views.table(spark, d, "pages").select("page_id", datasets.domain(F.col("url")).alias("domain"))


def credibility_join(spark, d):
    pages = views.table(spark, d, "pages").select("page_id", datasets.domain(F.col("url")).alias("domain"))
    media = spark.createDataFrame([("example.com", "high"), ("site1.example", "medium"), ("site2.example", "low"), ("example.org", "medium")], "domain string, credibility string")
    return rounded(datasets.credibility(pages, media, {"high": 1.0, "medium": 0.6, "low": 0.2}, 0.5).groupBy("credibility", "reliability").agg(F.count("*").alias("n")))


def reliability_estimate(spark, d):
    """An evaluator's reliability from what its means by sample detect."""
    rows = experiments.side_scores(_evidence(spark, d), _claims(spark, d))
    report = metrics.detection_report(rows.select("evaluator", "side", "score", "positive"), ["evaluator", "side"])
    return rounded(experiments.estimated_reliability(report, ["evaluator"]))


def _nested(spark, d) -> DataFrame:
    """Samples as readers.SAMPLE says, one claim each; those without documents have none."""
    one = F.struct("pos", F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("retrieval_score"), "reliability")
    docs = views.contexts(spark, d).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda c: c.dropFields("pos")).alias("contexts"))
    rows = _claims(spark, d).join(docs, "sample_id", "left")
    name = F.col("sample_id").cast("string")
    empty = F.array().cast(docs.schema["contexts"].dataType)
    claim = F.array(F.struct(F.col("claim_id").cast("string").alias("claim_id"), F.concat(F.lit("claim "), name).alias("text")))
    return rows.select(name.alias("sample_id"), F.lit("").alias("question"), F.lit("").alias("answer"), F.lit(None).cast("string").alias("reference_answer"), claim.alias("claims"), F.coalesce("contexts", empty).alias("contexts"), "gold_state")


def checking_violations(spark, d):
    """Results of which some are missing, come twice, belong to no sample, or have other documents, shapes or labels."""
    q, first = F.col("query_id"), F.concat(F.array(F.lit("maybe")), F.expr("slice(labels[0], 2, size(labels[0]))"))
    rows = _checked(spark, d).filter(q % 17 != 0)
    labels = F.when(q % 29 == 0, F.array(F.get("labels", F.lit(0)), F.expr("slice(labels[1], 1, size(labels[1]) - 1)"))).otherwise(F.col("labels"))
    rows = rows.withColumn("labels", labels).withColumn("labels", F.when(q % 37 == 0, F.expr("slice(labels, 1, 0)")).when(q % 31 == 0, F.concat(F.array(first), F.expr("slice(labels, 2, 1)"))).otherwise(F.col("labels")))
    docs = F.when(q % 23 == 0, F.reverse("doc_ids")).otherwise(F.col("doc_ids"))
    rows = rows.withColumn("doc_ids", docs).withColumn("doc_ids", F.when(q % 41 == 0, F.expr("slice(doc_ids, 1, size(doc_ids) - 1)")).otherwise(F.col("doc_ids")))
    rows = rows.unionByName(rows.filter(q % 19 == 0)).unionByName(_checked(spark, d).filter((q % 43 == 0) & (q % 17 != 0)).withColumn("query_id", -q))
    found = ingestion.violations(rows, _nested(spark, d).filter(F.size("contexts") > 0))
    return found.select("kind", F.col("query_id").cast("long").alias("query_id"))


def relations_from_results(spark, d):
    """Strictly read results as relations, by label."""
    good = ingestion.checked(_checked(spark, d), _nested(spark, d).filter(F.size("contexts") > 0))
    mapping = {"entailment": (0.85, 0.05, 0.1), "neutral": (0.1, 0.1, 0.8), "contradiction": (0.05, 0.85, 0.1)}
    found = builders.relations_from_counts(ingestion.label_counts(good), mapping, "checker")
    return rounded(found.select(F.col("claim_id").cast("long").alias("query_id"), "doc_id", "evaluator", "p_support", "p_refute", "p_unknown"))


def _judge(spark, d) -> DataFrame:
    """A judge that leaves out some claims, refuses some, and gives a label of its own in places."""
    c = F.col("claim_id")
    label = F.element_at(F.array(*map(F.lit, [*views.STATES, "other"])), (c * 7 % 5 + 1).cast("int"))
    said = _claims(spark, d).filter(c % 9 != 0).select("sample_id", "claim_id", label.alias("label"), (c % 14 == 0).alias("refused"), (c % 50 + 100).alias("input_tokens"), (c % 3 + 5).alias("output_tokens"))
    return judges.judged(_claims(spark, d), said)


def judge_accounts(spark, d):
    return judges.accounts(_judge(spark, d))


def judge_report(spark, d):
    return rounded(judges.report(_judge(spark, d), RESAMPLES))


def judge_comparison(spark, d):
    run = baselines.run_baselines(_claims(spark, d), _evidence(spark, d), BASE, "e1").withColumnRenamed("state", "predicted")
    return rounded(judges.compare_with_run(_judge(spark, d), kept(run, "run"), RESAMPLES))


def round_trip(spark, d):
    """Samples and both evaluators' relations written as JSON lines with their manifests, read verified, fused, written as flat
    CSV and read again."""
    at, samples, name = f"{shared_dir(spark)}/evidra-trip-{uuid.uuid4().hex}", _nested(spark, d), "orders"
    builds.publish(spark, at, {"all": {"samples": samples}}, name, {"name": "orders"}, 0, {"all": 0}, {}, compression="gzip")
    own = files.read_mapping(spark, f"{at}/manifest.json")["splits"]["all"]["samples"]
    text = lambda *names: [F.col(c).cast("string").alias(c) for c in names]
    for e in views.EVALUATORS:
        rows = _evidence(spark, d).filter(F.col("evaluator") == e).select(*text("sample_id", "claim_id", "doc_id"), "evaluator", "p_support", "p_refute", "p_unknown", "evaluator_reliability")
        writers.write_relations(rows, f"{at}/all_{e}", compression="gzip")
        run = files.model_run(spark, name, "all", e, "view", e, own, f"{at}/all_{e}", f"{at}/all_{e}", {}, "continuous_probabilities", reliability=views.EVALUATORS[e])
        files.write_manifest(spark, run, f"{at}/all_{e}_run.json")
    s, r = readers.read_verified(spark, f"{at}/manifest.json", at + "/{split}_{evaluator}", list(views.EVALUATORS), at + "/{split}_{evaluator}_run.json", ["all"])
    s = kept(s, "samples")  # claims, documents and texts are taken of them: lines are parsed once
    results = fusion.run_pipeline(readers.claims_of(s), fusion.nested_evidence(r, s), GATES)
    writers.write_pipeline_csv(writers.pipeline_rows(results.drop("claim_text"), s), f"{at}/flat", compression="gzip")
    kinds = {"m_support": "double", "m_refute": "double", "m_theta": "double", "k_doc": "double", "k_eval": "double", "context_count": "long", "evidence_insufficient": "boolean", "document_conflict": "boolean", "evaluator_disagreement": "boolean", "claim_id": "long", "sample_id": "long"}
    flat = spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in writers.PIPELINE_COLUMNS)).option("header", True).csv(f"{at}/flat")
    return rounded(flat.drop("sample_id", "claim_text"))


def stepwise_discount(spark, d):
    """Masses discounted by their document's and then by their evaluator's reliability, with the product of both."""
    rows = fusion.discount(fusion.discount(fusion.identified(_evidence(spark, d)), F.col("doc_reliability")), F.col("evaluator_reliability"))
    return rounded(rows.select("claim_id", "doc_id", "evaluator", *MASSES, "reliability_applied"), 9)


def _label_counts(spark, d) -> DataFrame:
    """The labels of strictly read checking results, with the fold of each claim: the first fold is for validation."""
    own = ingestion.label_counts(ingestion.checked(_checked(spark, d), _nested(spark, d).filter(F.size("contexts") > 0)))
    folds = experiments.stratified_folds(_claims(spark, d), FOLDS).select(F.col("sample_id").cast("string").alias("sample_id"), "fold")
    return kept(own.join(folds, "sample_id"), "labels")


def _annotated(spark, d) -> DataFrame:
    text = lambda *names: [F.col(c).cast("string").alias(c) for c in names]
    return views.voted_relations(spark, d).select(*text(*calibration.PAIR), *calibration.P)


def _mapping(spark, d, counts) -> DataFrame:
    return calibration.calibrate(counts.filter("fold = 0"), _annotated(spark, d), calibration.SPLIT, default=calibration.DEFAULT_MAPPING)


def calibrated_mapping(spark, d):
    """What a checking model's labels mean, by the annotations of the validation fold."""
    return rounded(_mapping(spark, d, _label_counts(spark, d)))


def calibrated_fusion(spark, d):
    """The other folds' claims fused from labels that mean what the validation fold says."""
    counts = _label_counts(spark, d)
    found = calibration.calibrated_relations(counts.filter("fold <> 0").drop("fold"), _mapping(spark, d, counts), "checker")
    return rounded(fusion.fuse_documents(fusion.nested_evidence(found, _nested(spark, d))).select(F.col("claim_id").cast("long").alias("claim_id"), "evaluator", *MASSES, "k_doc", "n_docs"))


def calibration_violations(spark, d):
    """Over labels of which some come twice or are empty, and annotations of which some lack or come twice."""
    counts, oracle, q = _label_counts(spark, d).drop("fold"), _annotated(spark, d), F.col("claim_id").cast("long")
    none = {f"n_{k}": F.when(q % 7 == 0, 0).otherwise(F.col(f"n_{k}")) for k in builders.CHECK_LABELS}
    counts = counts.withColumns(none).unionByName(counts.filter(q % 5 == 0))
    oracle = oracle.filter(q % 11 != 0)
    found = calibration.violations(counts, oracle.unionByName(oracle.filter(q % 13 == 0)))
    return found.select("kind", F.col("claim_id").cast("long").alias("claim_id"), F.col("doc_id").cast("long").alias("doc_id"))


def _configured(spark, d, section: dict) -> str:
    """A folder with samples, relations and a configuration of a run; returns the configuration's path."""
    at, text = f"{shared_dir(spark)}/evidra-run-{uuid.uuid4().hex}", lambda *names: [F.col(c).cast("string").alias(c) for c in names]
    writers.write_samples(_nested(spark, d), f"{at}/samples", compression="gzip")
    writers.write_relations(_evidence(spark, d).select(*text(*calibration.PAIR), "evaluator", *calibration.P, "evaluator_reliability"), f"{at}/relations", compression="gzip")
    config = {"paths": {"samples": "samples", "relation_predictions": "relations", "output_jsonl": "out/results", "output_csv": "out/flat"}, "output": {"compression": "gzip"}} | section
    files.write_manifest(spark, config, f"{at}/run.yaml")
    return f"{at}/run.yaml"


def configured_run(spark, d):
    """The pipeline as a configuration file says, from files to files."""
    found = runs.run_pipeline(spark, _configured(spark, d, {"diagnostics": {"theta_threshold": THETA, "document_conflict_threshold": K_DOC, "evaluator_conflict_threshold": K_EVAL}}))
    cols = ["status", F.col("context_count").cast("long").alias("context_count"), *MASSES, "k_doc", "k_eval", "region", "verdict", "primary_state", "evidence_insufficient", "document_conflict", "evaluator_disagreement", "gold_state"]
    return rounded(found.select(F.col("claim_id").cast("long").alias("claim_id"), *cols))


def configured_baselines(spark, d):
    """The baselines as a configuration file says, from files to files."""
    section = {"decision_threshold": BASE.decision, "conflict_threshold": BASE.conflict, "conflict_margin": BASE.margin, "single_evaluator": "e1"}
    found = runs.run_baselines(spark, _configured(spark, d, {"baseline": section}))
    return found.groupBy("method", "state", "reason").agg(F.count("*").alias("n"))


def _named(f, name):
    f.__name__ = name
    return f


QUERIES = {
    f.__name__: f
    for f in (
        discount_projection, doc_fusion, k_doc_trace, evaluator_fusion, pipeline_diagnostics, many_document_fusion, status_diagnostics, pipeline_summary, selective_confidence, integrity_violations, first_n_documents,
        *(_named(_baseline(m), m) for m in ("weighted_average", "majority_vote", "single_evaluator", "conflict_aware")), baseline_summary, stat_gate_scores, stat_gate_decisions,
        confusion_matrix, class_metrics, classification_report, detection_report, detection_proxies, auroc_by_doc_count, observed_grid, ds_threshold_search, baseline_threshold_search, grid_health, conflict_aware_search, stat_gate_search,
        ablation, reliability_sweep, verdict_scores, stratified_folds, nested_cv, nested_cv_methods, nested_cv_margins, nested_ablation, baseline_long, comparison_report, reliability_sensitivity,
        _named(_estimated_folds("auroc"), "estimated_reliability_folds"), _named(_estimated_folds("macro_f1"), "estimated_macro_f1_folds"), estimated_reliability_cv,
        _named(_estimated_methods("auroc"), "estimated_methods_cv"), _named(_estimated_methods("macro_f1"), "estimated_methods_macro_f1_cv"), seed_robustness, relation_counts, pair_violations,
        credibility_verdicts, credibility_comparison, credibility_grid, checking_violations, relations_from_results, judge_accounts, judge_report, judge_comparison, round_trip, stepwise_discount, calibrated_mapping, calibrated_fusion, calibration_violations, configured_run, configured_baselines, risk_coverage, aurc, paired_bootstrap, bootstrap_interval, paired_auroc_bootstrap, paired_selective_bootstrap, compare_runs, label_calibration, relation_comparison, vote_distribution,
        entropy_reliability, claim_dedup, passage_windows, passage_tfidf_top1, balanced_split, vote_relations, relations_from_labels, label_contingency, url_domain, credibility_join, reliability_estimate,
    )
}

ORACLE_SQL = oracle.ORACLE_SQL | oracle_studies.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
