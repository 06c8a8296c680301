"""Datasets from annotated sources: balanced splits, samples, relations of human votes, provenance, and results of a
checking model as relations. Samples are nested rows (claims and contexts as arrays), as readers.SAMPLE says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.datasets import best_passage, credibility, domain, normalised_text, windows

# Source labels and the states they stand for.
FEVER_STATES = {"SUPPORTS": "supported", "REFUTES": "refuted", "NOT_ENOUGH_INFO": "insufficient", "DISPUTED": "conflicting"}
QA_STATES = {"Supported": "supported", "Refuted": "refuted", "Not Enough Evidence": "insufficient", "Conflicting Evidence/Cherrypicking": "conflicting"}
CHECK_LABELS = ["entailment", "neutral", "contradiction"]
SPLITS = ("train", "validation", "test")


def balanced_split(rows: DataFrame, text: str, label: str, order: Column, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """rows with a split: of rows with equal normalised text the first by order stays; of each label as many as counts say
    are drawn for each split, in the order of a seeded hash. A label with too few rows is an error."""
    needed = sum(counts.values())
    first = Window.partitionBy("_digest").orderBy(order)
    distinct = rows.withColumns({"_digest": F.sha2(normalised_text(F.col(text)), 256), "_order": order}).withColumn("_first", F.row_number().over(first)).filter("_first = 1")
    drawn = Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_order").cast("string"))), "_order")
    # no more than the rows that are needed of a label meet in its window
    taken = distinct.withColumn("_k", F.row_number().over(drawn)).filter(F.col("_k") <= needed)
    few = [(r[0], r[1]) for r in taken.groupBy(label).count().filter(F.col("count") < needed).collect()]
    if few:
        raise ValueError(f"too few distinct rows for {needed}: {few}")
    bound, split = 0, F.lit(None)
    for name in reversed(list(counts)):
        split = F.when(F.col("_k") <= needed - bound, name).otherwise(split) if bound else F.lit(name)
        bound += counts[name]
    return taken.withColumn("split", split).drop("_digest", "_order", "_first", "_k")


def _state(label: Column, states: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in states.items() for x in kv))
    return F.coalesce(F.try_element_at(known, label), F.raise_error(F.concat(F.lit("unknown label "), label)).cast("string"))


def _sample(rows: DataFrame, sample_id: Column, claim: Column, question: Column, contexts: Column, state: Column, *more: str) -> DataFrame:
    contexts = F.transform(contexts, lambda c, i: F.struct(F.concat(sample_id, F.lit("-d"), (i + 1).cast("string")).alias("doc_id"), c["text"].alias("text"), F.lit(None).cast("double").alias("retrieval_score"), c["reliability"].alias("reliability")))
    claims = F.array(F.struct(F.concat(sample_id, F.lit("-c1")).alias("claim_id"), claim.alias("text")))
    return rows.select(sample_id.alias("sample_id"), question.alias("question"), claim.alias("answer"), F.lit(None).cast("string").alias("reference_answer"), claims.alias("claims"), contexts.alias("contexts"), state.alias("gold_state"), *more)


def asked(claim: Column) -> Column:
    """The question that a claim answers."""
    return F.concat(F.lit("Is the following claim true? "), claim)


def fever_id(claim_id: Column) -> Column:
    return F.format_string("climate-fever-%04d", claim_id.cast("long"))


def fever_samples(source: DataFrame, *more: str) -> DataFrame:
    """Samples of rows (claim_id, claim, claim_label, evidences: array of evidence_id, evidence_label, article, evidence,
    entropy, votes)."""
    claim = F.trim("claim")
    contexts = F.transform("evidences", lambda e: F.struct(F.trim(e["evidence"]).alias("text"), F.lit(1.0).alias("reliability")))
    return _sample(source, fever_id(F.col("claim_id")), claim, asked(claim), contexts, _state(F.col("claim_label"), FEVER_STATES), *more)


def vote_relations(source: DataFrame, evaluator: str = "human_votes") -> DataFrame:
    """Relations of the votes on each evidence; without a vote the evidence's own label counts as one."""
    sample = fever_id(F.col("claim_id"))
    each = source.select(sample.alias("sample_id"), F.posexplode("evidences").alias("i", "e"))
    votes = F.filter("e.votes", lambda v: v.isNotNull())
    votes = F.when(F.size(votes) > 0, votes).otherwise(F.array("e.evidence_label"))
    share = lambda k: (F.size(F.filter(votes, lambda v: v == k)) / F.size(votes)).cast("double")
    return each.select(
        "sample_id", F.concat("sample_id", F.lit("-c1")).alias("claim_id"), F.concat("sample_id", F.lit("-d"), (F.col("i") + 1).cast("string")).alias("doc_id"), F.lit(evaluator).alias("evaluator"),
        share("SUPPORTS").alias("p_support"), share("REFUTES").alias("p_refute"), share("NOT_ENOUGH_INFO").alias("p_unknown"), F.lit(1.0).alias("evaluator_reliability"),
    )


def fever_provenance(source: DataFrame, dataset: str = "CLIMATE-FEVER") -> DataFrame:
    """(sample_id, split, source of the claim and of each context) of rows with a split."""
    sample = fever_id(F.col("claim_id"))
    contexts = F.transform("evidences", lambda e, i: F.struct(F.concat(sample, F.lit("-d"), (i + 1).cast("string")).alias("doc_id"), e["evidence_id"].alias("source_evidence_id"), e["article"].alias("article"), e["evidence_label"].alias("evidence_label"), e["entropy"].alias("entropy"), e["votes"].alias("votes")))
    return source.select(sample.alias("sample_id"), "split", F.lit(dataset).alias("source_dataset"), F.col("claim_id").alias("source_claim_id"), F.col("claim_label").alias("source_claim_label"), _state(F.col("claim_label"), FEVER_STATES).alias("mapped_gold_state"), contexts.alias("contexts"))


def qa_text(question: Column, answer: Column, explanation: Column) -> Column:
    """The text of a document made of a question, its answer and why."""
    full = F.when(F.length(F.trim(F.coalesce(explanation, F.lit("")))) > 0, F.concat(F.trim(answer), F.lit(". "), F.trim(explanation))).otherwise(F.trim(answer))
    return F.when(F.length(F.trim(F.coalesce(question, F.lit("")))) > 0, F.concat(F.lit("Question: "), F.trim(question), F.lit(" Answer: "), full)).otherwise(full)


def _qa_id() -> Column:
    return F.format_string("averitec-%s-%04d", F.col("source_split"), F.col("index").cast("long"))


def _qa_documents() -> Column:
    return F.flatten(F.transform("questions", lambda q: F.transform(q["answers"], lambda a: a.withField("question", q["question"]))))


def qa_samples(source: DataFrame, *more: str) -> DataFrame:
    """Samples of rows (source_split, index, claim, label, questions with answers): a document for each answer; a claim
    without questions has none. Rows of a blank claim are left out."""
    claim = F.trim("claim")
    contexts = F.transform(F.coalesce(_qa_documents(), F.array()), lambda a: F.struct(qa_text(a["question"], a["answer"], a["boolean_explanation"]).alias("text"), F.lit(1.0).alias("reliability")))
    return _sample(source.filter(F.length(claim) > 0), _qa_id(), claim, asked(claim), contexts, _state(F.col("label"), QA_STATES), *more)


def qa_provenance(source: DataFrame, dataset: str = "AVeriTeC") -> DataFrame:
    """(sample_id, split, source of the claim and of each context) of rows with a split."""
    contexts = F.transform(F.coalesce(_qa_documents(), F.array()), lambda a, i: F.struct(F.concat(_qa_id(), F.lit("-d"), (i + 1).cast("string")).alias("doc_id"), a["answer_type"].alias("answer_type"), a["source_url"].alias("source_url"), a["source_medium"].alias("source_medium")))
    return source.select(_qa_id().alias("sample_id"), "split", F.lit(dataset).alias("source_dataset"), "source_split", F.col("index").alias("source_index"), F.col("label").alias("source_label"), _state(F.col("label"), QA_STATES).alias("mapped_gold_state"), contexts.alias("contexts"))


def web_contexts(claims: DataFrame, pages: DataFrame, media: DataFrame, values: dict[str, float], unrated: float, **windowing) -> DataFrame:
    """(sample_id, doc_id, pos, text, url, domain, credibility, reliability, passage, passages) of claims (sample_id, text) and
    their pages (sample_id, evidence_id, content, url): the passage of each page that is nearest to the claim. Pages
    without a word are left out; a claim with none left has no row."""
    keyed = pages.withColumn("doc_key", F.concat_ws("\u0001", "sample_id", F.col("evidence_id").cast("string")))
    parts = windows(keyed, "doc_key", "content", **windowing).withColumns({"query_id": F.substring_index("doc_key", "\u0001", 1), "doc_id": F.col("doc_key")})
    best = best_passage(claims.select(F.col("sample_id").alias("query_id"), "text"), parts.select("query_id", "doc_id", "passage", "text"))
    number = parts.groupBy("doc_key").agg(F.count("*").alias("passages"))
    chosen = parts.join(best.select("doc_id", "passage"), ["doc_id", "passage"]).join(number, "doc_key")
    rated = credibility(keyed.select("doc_key", "sample_id", "evidence_id", "url", domain(F.col("url")).alias("domain")), media, values, unrated)
    at = Window.partitionBy("sample_id").orderBy("evidence_id")
    rows = rated.join(chosen.select("doc_key", "passage", "passages", "text"), "doc_key").withColumn("pos", F.row_number().over(at) - 1)
    return rows.select("sample_id", F.concat("sample_id", F.lit("-d"), (F.col("pos") + 1).cast("string")).alias("doc_id"), "pos", "text", "url", "domain", "credibility", "reliability", "passage", "passages")


def claims_replaced(samples: DataFrame, extracted: DataFrame) -> DataFrame:
    """samples with the claims that an extractor found (sample_id, claim_id, claim_text); one without any is an error."""
    found = extracted.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", F.col("claim_text").alias("text")))).alias("_claims"))
    lost = F.raise_error(F.concat(F.lit("no claim of "), F.col("sample_id").cast("string")))
    return samples.join(found, "sample_id", "left").withColumn("claims", F.when(F.col("_claims").isNull(), lost).otherwise(F.col("_claims"))).drop("_claims")


def claim_text(entry: Column) -> Column:
    """The text of a claim given as such or as a JSON object with the key text, claim or content."""
    inside = F.coalesce(*(F.get_json_object(entry, f"$.{k}") for k in ("text", "claim", "content")))
    return F.trim(F.when(F.trim(entry).startswith("{"), inside).otherwise(entry))


def answer_label(text: Column, labels: list[str]) -> Column:
    """The label of a JSON answer with the key label, in lower case; null if it is none of labels."""
    label = F.lower(F.trim(F.get_json_object(text, "$.label")))
    return F.when(label.isin(labels), label)


def aligned(results: DataFrame, contexts: DataFrame) -> DataFrame:
    """results (query_id, doc_ids); one whose documents aren't those of its sample (sample_id, doc_id, pos), in their order,
    and a sample without a result, are errors as their rows are read."""
    own = contexts.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda c: c["doc_id"]).alias("_own"))
    df = results.join(own, results["query_id"] == own["sample_id"], "full")
    lost = F.raise_error(F.concat(F.lit("no result for "), F.col("sample_id").cast("string"))).cast(results.schema["query_id"].dataType)
    df = df.withColumn("query_id", F.when(F.col("query_id").isNull(), lost).otherwise(F.col("query_id"))).drop("sample_id")
    wrong = F.raise_error(F.concat(F.lit("documents differ in "), F.col("query_id").cast("string")))
    return df.withColumn("doc_ids", F.when(F.transform("doc_ids", lambda x: F.trim(x)).eqNullSafe(F.col("_own")), F.col("_own")).otherwise(wrong)).drop("_own")


def relations_from_counts(counts: DataFrame, mapping: dict[str, tuple[float, float, float]], evaluator: str, reliability: float = 1.0) -> DataFrame:
    """Relations of label counts (keys, n_entailment, n_neutral, n_contradiction): the mean of what each label stands for
    (support, refute, unknown). A pair without a label is an error as its row is read."""
    n = sum(F.col(f"n_{k}") for k in CHECK_LABELS)
    mean = lambda i: (sum(F.col(f"n_{k}") * F.lit(float(mapping[k][i])) for k in CHECK_LABELS) / n)
    lost = F.raise_error(F.concat(F.lit("no label for "), F.concat_ws("/", *(F.col(c).cast("string") for c in counts.columns if not c.startswith("n_"))))).cast("long")
    n = F.when(n > 0, n).otherwise(lost)
    out = counts.withColumns({"p_support": mean(0), "p_refute": mean(1), "p_unknown": mean(2)})
    total = F.col("p_support") + F.col("p_refute") + F.col("p_unknown")
    out = out.withColumns({p: F.col(p) / total for p in ("p_support", "p_refute", "p_unknown")})
    return out.drop(*(f"n_{k}" for k in CHECK_LABELS)).withColumns({"evaluator": F.lit(evaluator), "evaluator_reliability": F.lit(float(reliability))})


def contingency(judged: DataFrame) -> DataFrame:
    """(label, oracle, n): how often a pair's label (majority; null where tied: left out) met the oracle's largest
    probability, or tie."""
    p = {k: F.col(f"p_{k}") for k in ("support", "refute", "unknown")}
    top = F.greatest(*p.values())
    winner = F.when(sum((x == top).cast("int") for x in p.values()) > 1, "tie")
    for k, x in p.items():
        winner = winner.when(x == top, k)
    return judged.filter("label IS NOT NULL").groupBy("label", winner.alias("oracle")).agg(F.count("*").alias("n"))


def majority_label(counts: DataFrame) -> Column:
    """The label with the most counts, null if several have."""
    n = {k: F.col(f"n_{k}") for k in CHECK_LABELS}
    top = F.greatest(*n.values())
    out = F.when(sum((x == top).cast("int") for x in n.values()) > 1, F.lit(None).cast("string"))
    for k, x in n.items():
        out = out.when(x == top, k)
    return out
