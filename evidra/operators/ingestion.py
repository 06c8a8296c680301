"""Results of a checking model against the samples that they were asked for.

Results are nested rows (query_id, doc_ids, labels[sub-claim][document] and, if there are, probabilities[sub-claim][document]
[entailment, neutral, contradiction]); samples are nested rows as readers.SAMPLE says. One full outer join sets them against
each other; everything else is checked within a row. What is wrong comes as a table of violations, or as an error when a
wrong row is read: nothing is left out, filled in or taken for neutral.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.builders import CHECK_LABELS

#: How far three probabilities may sum from 1.
TOLERANCE = 1e-3


def _label(x: Column) -> Column:
    return F.lower(F.trim(x))


def _rows(column: Column, wrong) -> Column:
    """The first rows of a matrix for which wrong holds, as numbers from 0."""
    numbered = F.transform(column, lambda row, i: F.struct(row.alias("row"), i.alias("i")))
    bad = F.transform(F.filter(numbered, lambda x: F.coalesce(wrong(x["row"]), F.lit(True))), lambda x: x["i"].cast("string"))
    return F.array_join(F.slice(bad, 1, 3), ",")


def _met(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples and results side by side; n_results is how often a query comes."""
    own = samples.select("sample_id", F.size("claims").alias("n_claims"), F.get("claims", F.lit(0))["claim_id"].alias("claim_id"), F.transform("contexts", lambda c: c["doc_id"]).alias("own"))
    more = [c for c in ("labels", "probabilities") if c in results.columns]
    found = results.select(F.trim(F.col("query_id").cast("string")).alias("query_id"), F.transform("doc_ids", lambda d: F.trim(d)).alias("doc_ids"), *more)
    found = found.withColumn("n_results", F.when(F.col("query_id").isNotNull(), F.count("*").over(Window.partitionBy("query_id"))))
    return own.join(found.withColumn("_there", F.lit(True)), F.col("sample_id") == F.col("query_id"), "full")


def _problems(met: DataFrame, single: bool) -> Column:
    """Each row's violations as an array of (kind, detail)."""
    there, known = F.col("_there").isNotNull(), F.col("sample_id").isNotNull()
    both, size = there & known, F.size("doc_ids")
    problem = lambda kind, when, detail=F.lit(""): F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.coalesce(detail, F.lit("")).alias("detail")))
    text = lambda x: x.cast("string")
    found = [
        problem("no_query_id", there & F.col("query_id").isNull()), problem("missing_result", known & ~there), problem("extra_result", there & F.col("query_id").isNotNull() & ~known),
        problem("repeated_result", both & (F.col("n_results") > 1), text(F.col("n_results"))), problem("claim_count", known & (F.col("n_claims") != 1), text(F.col("n_claims"))),
        problem("no_documents", both & F.col("doc_ids").isNull()), problem("document_count", both & (size != F.size("own")), F.concat(text(size), F.lit(" of "), text(F.size("own")))),
        problem("document_order", both & (size == F.size("own")) & ~F.col("doc_ids").eqNullSafe(F.col("own")), F.array_join("doc_ids", ",")),
    ]
    matrices = [("labels", lambda r: F.size(r) != F.size("doc_ids"))] + ([("probabilities", lambda r: F.size(r) != F.size("doc_ids"))] if "probabilities" in met.columns else [])
    for name, wrong in matrices:
        bad = _rows(F.col(name), wrong)
        found += [problem(f"no_{name}", both & F.col(name).isNull()), problem(f"empty_{name}", both & (F.size(name) == 0)), problem(f"{name}_shape", both & (bad != ""), bad)]
    known_label = lambda r: F.forall(r, lambda x: F.coalesce(_label(x).isin(CHECK_LABELS), F.lit(False)))
    unknown = _rows(F.col("labels"), lambda r: ~known_label(r))
    found += [problem("unknown_label", both & (unknown != ""), unknown)]
    if single:
        found += [problem("several_claims", both & (F.size("labels") > 1), text(F.size("labels")))]
    if "probabilities" in met.columns:
        total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
        sane = lambda p: F.coalesce((F.size(p) == 3) & F.forall(p, lambda x: F.coalesce(x.between(0, 1), F.lit(False))), F.lit(False))
        values = _rows(F.col("probabilities"), lambda r: ~F.forall(r, sane))
        sums = _rows(F.col("probabilities"), lambda r: F.exists(r, lambda p: sane(p) & (F.abs(total(p) - 1) > TOLERANCE)))
        found += [problem("probability_values", both & (values != ""), values), problem("probability_sum", both & (sums != ""), sums), problem("other_claims", both & (F.size("labels") != F.size("probabilities")))]
    return F.array_compact(F.array(*found))


def violations(results: DataFrame, samples: DataFrame, single: bool = False) -> DataFrame:
    """(kind, query_id, detail) of all that is wrong with results; a repeated result is named once for each time. single: a
    result with more than one sub-claim is wrong as well."""
    met = _met(results, samples)
    named = F.coalesce("query_id", "sample_id").alias("query_id")
    return met.select(named, F.explode(_problems(met, single)).alias("x")).select("x.kind", "query_id", "x.detail")


def checked(results: DataFrame, samples: DataFrame, single: bool = False) -> DataFrame:
    """(sample_id, claim_id, doc_ids, labels and probabilities if there are) of results without a violation; with one, its row
    is an error as it is read, that names the query and what is wrong."""
    met = _met(results, samples)
    first = F.get(F.col("_wrong"), F.lit(0))
    said = F.concat(F.lit("checking results: "), first["kind"], F.lit(" "), first["detail"], F.lit(" in "), F.coalesce("query_id", "sample_id", F.lit("null")))
    rows = met.withColumn("_wrong", _problems(met, single))
    sample = F.when(F.size("_wrong") > 0, F.raise_error(said).cast("string")).otherwise(F.col("sample_id").cast("string"))
    more = [c for c in ("labels", "probabilities") if c in results.columns]
    return rows.select(sample.alias("sample_id"), "claim_id", F.col("own").alias("doc_ids"), *more)


def label_counts(good: DataFrame) -> DataFrame:
    """(sample_id, claim_id, doc_id, n_entailment, n_neutral, n_contradiction) of checked() results: the labels that a document
    has over the sub-claims. Counted within each row, without a shuffle."""
    each = good.select("sample_id", "claim_id", "labels", F.posexplode("doc_ids").alias("i", "doc_id"))
    own = F.transform("labels", lambda row: _label(F.get(row, F.col("i"))))
    return each.select("sample_id", "claim_id", "doc_id", *(F.size(F.filter(own, lambda x: x == k)).cast("long").alias(f"n_{k}") for k in CHECK_LABELS))  # noqa: B023


def probability_relations(good: DataFrame, evaluator: str, reliability: float = 1.0) -> DataFrame:
    """Relations of checked() results with probabilities: the mean over sub-claims, renormalised."""
    if not evaluator.strip():
        raise ValueError("an evaluator needs a name")
    each = good.select("sample_id", "claim_id", "probabilities", F.posexplode("doc_ids").alias("i", "doc_id"))
    mean = lambda k: F.aggregate("probabilities", F.lit(0.0), lambda a, row: a + F.get(F.get(row, F.col("i")), F.lit(k))) / F.size("probabilities")
    p = each.withColumns({"_e": mean(0), "_n": mean(1), "_c": mean(2)})
    total = F.col("_e") + F.col("_n") + F.col("_c")
    return p.select("sample_id", "claim_id", "doc_id", F.lit(evaluator).alias("evaluator"), *((F.col(c) / total).alias(n) for c, n in (("_e", "p_support"), ("_c", "p_refute"), ("_n", "p_unknown"))), F.lit(float(reliability)).alias("evaluator_reliability"))
