"""Ingestion and dataset building: votes, calibration, deduplication, passages, retrieval of a passage, domains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.tables import kept


def normalised_text(text: Column) -> Column:
    """White space collapsed, trimmed, case folded: letters that differ in case only, or in a longer form as ß and ss, are
    one."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    # upper case has the longer forms; translate() keeps Spark from dropping it before lower()
    return F.translate(F.lower(F.translate(F.upper(flat), "\0", "")), "ς", "σ")


def dedup_first(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row (by order) of each normalised text: a grouped minimum of small rows, then a join on its id."""
    first = df.groupBy(F.sha2(normalised_text(F.col(text)), 256).alias("digest")).agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return first


def windows(df: DataFrame, key: str, text: str, size: int = 120, stride: int = 60, most: int | None = None) -> DataFrame:
    """(key, passage, start, text): windows of words, up to the one that covers the end. Whole texts are read; with most,
    only so many words of each, and the column truncated says of which documents words are left out."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    rows = df.select(key, words.alias("w")).filter(F.size("w") > 0)
    cut = [] if most is None else ["truncated"]
    if most is not None:
        rows = rows.select(key, F.slice("w", 1, most).alias("w"), (F.size("w") > most).alias("truncated"))
    last = F.ceil(F.greatest(F.size("w") - size, F.lit(0)) / stride).cast("int")
    # joined before they are dealt out: a row for each window would carry all words of its text
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * stride).alias("start"), F.array_join(F.slice("w", i * stride + 1, size), " ").alias("text")))
    return rows.select(key, *cut, F.posexplode(each).alias("passage", "x")).select(key, "passage", "x.start", "x.text", *cut)


#: A term is a run of two letters, digits or underscores at least, in any script.
TERM = r"([\p{L}\p{N}_]{2,})"


def terms(text: Column) -> Column:
    """Lower-case terms."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 1)


# English words that say nothing about a passage (Spark's own list, without those that have an apostrophe).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn
wasn weren won wouldn
""".split()


#: Passages that a task holds at once to weigh their terms, about (a document's are held together).
PASSAGES = 4000


def _term_counts(table: pa.Table, stop_words: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of passages (doc_id, passage, terms): the first row of each (document, passage), and by passage and term, as places in
    these and among the distinct terms, how often a term occurs; stop words are left out."""
    lists = table.column("terms").combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(lists.flatten())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    doc = pc.dictionary_encode(table.column("doc_id").combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    passage = table.column("passage").to_numpy().astype(np.int64)
    _, first, own = np.unique(doc * (passage.max(initial=0) + 1) + passage, return_index=True, return_inverse=True)
    code, number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
    plain = ~pc.is_in(coded.dictionary, pa.array(stop_words, pa.string())).to_numpy(zero_copy_only=False) if len(coded.dictionary) else np.ones(1, bool)
    pair = np.repeat(own.astype(np.int64), size) * number + code
    pair, times = np.unique(pair[plain[code]], return_counts=True)
    return table.take(pa.array(first)), pair // number, pair % number, times, coded.dictionary


def best_passage(queries: DataFrame, passages: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Of each query (query_id, text) and document (doc_id, passage, text; query_id) the passage of the highest TF-IDF
    cosine; ties and zeros go to the first. The vocabulary is that of the query's own passages and the query.

    A query's passages are dealt to chunks by their document. A chunk counts its own terms; the counts, a row for each distinct
    term of a chunk, meet by query and term, and the chunk's terms come back with their weights. No term of a passage is a row."""
    kind = {c: passages.schema[c].dataType.simpleString() for c in ("query_id", "doc_id", "passage")}
    own = kept(passages.select("query_id", "doc_id", "passage", "text"), "passages")
    sizes = own.groupBy("query_id").agg(F.count("*").alias("_n"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.ceil(F.coalesce("_n", F.lit(1)) / PASSAGES)).cast("int")
    dealt = own.join(sizes, "query_id", "left").select("query_id", chunk.alias("_chunk"), "doc_id", "passage", "text").repartition("query_id", "_chunk")
    dealt = dealt.select("query_id", "_chunk", "doc_id", "passage", terms(F.col("text")).alias("terms"))

    def count(table: pa.Table) -> pa.Table:
        _, _, code, _, words = _term_counts(table, stop_words)
        found, times = np.unique(code, return_counts=True)
        same = lambda c: pa.repeat(table.column(c)[0], len(found))
        return pa.table({"query_id": same("query_id"), "_chunk": same("_chunk"), "term": words.take(pa.array(found)).cast(pa.string()), "k": pa.array(times, pa.int64())})

    counts = kept(dealt.groupBy("query_id", "_chunk").applyInArrow(count, f"query_id {kind['query_id']}, _chunk int, term string, k long"), "terms")
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).filter(~F.col("term").isin(stop_words)).groupBy("query_id", "term").agg((1 + F.log(F.count("*"))).alias("_tf"))
    df = F.sum("k").over(Window.partitionBy("query_id", "term")) + F.when(F.col("_tf").isNull(), 0).otherwise(1)
    met = counts.join(asked, ["query_id", "term"], "left").join(sizes, "query_id", "left")
    met = met.withColumn("idf", F.log((2 + F.coalesce("_n", F.lit(0))) / (1 + df)) + 1)
    known = met.select("query_id", "_chunk", "term", "idf", (F.coalesce("_tf", F.lit(0.0)) * F.col("idf")).alias("asked"))

    def score(table: pa.Table, weights: pa.Table) -> pa.Table:
        first, row, code, times, words = _term_counts(table, stop_words)
        at = pc.index_in(words.cast(pa.string()), weights.column("term").combine_chunks()).to_numpy(zero_copy_only=False)[code].astype(np.int64)
        idf, asked = (weights.column(c).to_numpy()[at] for c in ("idf", "asked"))
        w = (1 + np.log(times)) * idf
        dot, norm = (np.bincount(row, x, first.num_rows) for x in (w * asked, w * w))
        return first.select(["query_id", "doc_id", "passage"]).append_column("score", pa.array(np.divide(dot, np.sqrt(norm), out=np.zeros(len(dot)), where=norm > 0)))

    scored = dealt.groupBy("query_id", "_chunk").cogroup(known.groupBy("query_id", "_chunk")).applyInArrow(score, ", ".join(f"{c} {t}" for c, t in kind.items()) + ", score double")
    top = F.min(F.struct((-F.round("score", 9)).alias("least"), "passage", "score")).alias("_x")
    return scored.groupBy("query_id", "doc_id").agg(top).select("query_id", "doc_id", "_x.passage", "_x.score")


def numbered(df: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """df with each row's place (from 0, as name) in the order of a distinct key, and the number of rows. The keys are
    sorted in parts and numbered part by part: no task sees them all."""
    placed = df.select(key).sort(key).rdd.map(tuple).zipWithIndex().map(lambda x: (*x[0], x[1]))
    kind = df.select(key).schema[0].dataType.simpleString()
    return df.join(df.sparkSession.createDataFrame(placed, f"`{key}` {kind}, `{name}` long"), key), df.count()


def domain(url: Column) -> Column:
    """The host in lower case without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def credibility(pages: DataFrame, media: DataFrame, values: dict[str, float], unrated: float) -> DataFrame:
    """pages (domain) with credibility and reliability: looked up by the host, then by its last two labels. media: a small
    table (domain, credibility); Spark sees its size and decides how to join. A credibility without a value is an error."""
    rated = media
    own = rated.select("domain", F.col("credibility").alias("_own"))
    base = rated.select(F.col("domain").alias("_base"), F.col("credibility").alias("_wide"))
    df = pages.join(own, "domain", "left").join(base, F.substring_index("domain", ".", -2) == F.col("_base"), "left").withColumn("credibility", F.coalesce("_own", "_wide"))
    known = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return df.withColumn("reliability", F.when(F.col("credibility").isNull(), unrated).otherwise(F.coalesce(F.try_element_at(known, F.col("credibility")), F.raise_error(F.concat(F.lit("no value for "), "credibility")).cast("double")))).drop("_own", "_base", "_wide")


def vote_distribution(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of the labels supports, refutes and not_enough_info among the non-null votes (keys, vote)."""
    n = F.count("vote")
    share = lambda v: F.try_divide(F.count(F.when(F.col("vote") == v, 1)), n)
    return votes.groupBy(*keys).agg(share("supports").alias("p_support"), share("refutes").alias("p_refute"), share("not_enough_info").alias("p_unknown"), n.alias("n_votes"))


def entropy_reliability(p: list[Column]) -> Column:
    """1 less the entropy over its maximum for three labels, within 0 and 1."""
    h = sum(F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in p)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - h / F.log(F.lit(3.0))))


def calibrate_labels(judged: DataFrame) -> DataFrame:
    """Of each label the weighted mean of the oracle's probabilities. judged: (label, weight, p_support, p_refute,
    p_unknown). See with_unseen() for labels that don't occur."""
    return judged.groupBy("label").agg(*((F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c) for c in ("p_support", "p_refute", "p_unknown")), F.sum("weight").alias("weight"))


def checking_labels(results: DataFrame) -> DataFrame:
    """Label counts of each (sample, claim, document) from nested checking results (query_id, doc_ids, labels[claim][doc]). A
    matrix that isn't there, has no row, or a row that hasn't a label for each document, is an error as it is read; see
    ingestion.py for results against their samples."""
    shaped = F.coalesce((F.size("labels") > 0) & F.forall("labels", lambda r: F.size(r) == F.size("doc_ids")), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("labels aren't [claim][document] in "), F.col("query_id").cast("string"))).cast("array<array<string>>")
    results = results.withColumn("labels", F.when(shaped, F.col("labels")).otherwise(wrong))
    claims = results.select("query_id", "doc_ids", F.posexplode("labels").alias("claim", "row"))
    cells = claims.select("query_id", "claim", F.posexplode("row").alias("doc", "label"), "doc_ids")
    given = F.lower(F.trim("label"))
    label = F.when(given.isin("entailment", "neutral", "contradiction"), given).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("label", F.lit("null")))).cast("string"))
    count = lambda v: F.count(F.when(F.col("label") == v, 1))
    cells = cells.select("query_id", "claim", F.get("doc_ids", "doc").alias("doc_id"), label.alias("label"))
    return cells.groupBy("query_id", "claim", "doc_id").agg(*(count(v).alias(f"n_{v}") for v in ("entailment", "neutral", "contradiction")))


def checking_probabilities(results: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Mean probabilities of each (sample, document) from probabilities[claim][doc] in the order entailment, neutral,
    contradiction, renormalised; a value outside 0 and 1, a triple that doesn't sum to 1, and a matrix of another shape are
    errors as they are read."""
    shaped = F.coalesce((F.size("probabilities") > 0) & F.forall("probabilities", lambda r: F.size(r) == F.size("doc_ids")), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("probabilities aren't [claim][document][3] in "), F.col("query_id").cast("string"))).cast("array<array<array<double>>>")
    results = results.withColumn("probabilities", F.when(shaped, F.col("probabilities")).otherwise(wrong))
    cells = results.select("query_id", "doc_ids", F.explode("probabilities").alias("row")).select("query_id", "doc_ids", F.posexplode("row").alias("doc", "p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    inside = F.coalesce(F.forall("p", lambda x: F.coalesce(x.between(0, 1), F.lit(False))), F.lit(False))
    ok = F.when((F.size("p") == 3) & inside & (F.abs(total - 1) <= tolerance), F.col("p")).otherwise(F.raise_error(F.lit("probabilities aren't within 0 and 1, or don't sum to 1")).cast("array<double>"))
    by = cells.select("query_id", F.get("doc_ids", "doc").alias("doc_id"), ok.alias("p")).groupBy("query_id", "doc_id").agg(*(F.avg(F.get("p", F.lit(i))).alias(n) for i, n in ((0, "e"), (2, "c"), (1, "n"))))
    return by.select("query_id", "doc_id", *((F.col(k) / (F.col("e") + F.col("c") + F.col("n"))).alias(n) for k, n in (("e", "p_support"), ("c", "p_refute"), ("n", "p_unknown"))))


def with_unseen(calibrated: DataFrame, default: dict[str, tuple[float, float, float]], allow: bool = False) -> DataFrame:
    """calibrate_labels() with the labels that it has not seen, at their default and with used_default; unless they are
    allowed, such a label is an error."""
    table = calibrated.sparkSession.createDataFrame([(k, *map(float, v)) for k, v in default.items()], "label string, _s double, _r double, _u double")
    df = table.join(calibrated, "label", "left").withColumn("used_default", F.col("weight").isNull() | (F.col("weight") == 0))
    value = lambda c, d: F.when(~F.col("used_default"), F.col(c)).otherwise(F.col(d) if allow else F.raise_error(F.concat(F.lit("label never seen: "), "label")).cast("double")).alias(c)
    return df.select("label", value("p_support", "_s"), value("p_refute", "_r"), value("p_unknown", "_u"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "used_default")
