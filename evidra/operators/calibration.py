"""What a checking model's labels mean, learned from annotated relations of the validation split.

Label counts (sample_id, claim_id, doc_id, n_entailment, n_neutral, n_contradiction), as ingestion.label_counts() makes them, are
set against the annotations of the same pairs. One join by pair and one aggregate with a row a task give all labels' means, how
many pairs they lead, and what they meet; a pair without an annotation, or with several, is an error and nothing is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.builders import CHECK_LABELS, majority_label, relations_from_counts
from evidra.operators.fusion import CLAIM

PAIR = [*CLAIM, "doc_id"]
P = ["p_support", "p_refute", "p_unknown"]
MET = ["support", "refute", "unknown", "tie"]

#: The only split that labels may be calibrated on.
SPLIT = "validation"

# What labels stand for (support, refute, unknown) as long as they aren't calibrated.
DEFAULT_MAPPING = {"entailment": (0.85, 0.05, 0.1), "neutral": (0.1, 0.1, 0.8), "contradiction": (0.05, 0.85, 0.1)}


def _named(df: DataFrame) -> Column:
    return F.concat_ws("/", *(F.col(c).cast("string") for c in PAIR))


def annotations(oracle: DataFrame, evaluator: str | None = None) -> DataFrame:
    """(pair, p_support, p_refute, p_unknown, n_oracle) of annotated relations, of one evaluator if it is named: a row for each
    pair, and how many relations it has."""
    own = oracle if evaluator is None else oracle.filter(F.col("evaluator") == evaluator)
    return own.groupBy(*PAIR).agg(*(F.max(c).alias(c) for c in P), F.count("*").alias("n_oracle"))


def oracle_index(oracle: DataFrame, evaluator: str | None = None) -> DataFrame:
    """annotations() with one relation a pair; a pair with several is an error as its row is read."""
    twice = F.raise_error(F.concat(F.lit("several annotations of "), _named(oracle))).cast("double")
    return annotations(oracle, evaluator).withColumns({c: F.when(F.col("n_oracle") == 1, F.col(c)).otherwise(twice) for c in P}).drop("n_oracle")


def violations(counts: DataFrame, oracle: DataFrame, evaluator: str | None = None) -> DataFrame:
    """(kind, pair) of what keeps counts from being calibrated: no_annotation, several_annotations, repeated_pair (several rows
    of counts) and no_label (all counts 0 or null). Annotations of other pairs are no violation."""
    total = sum(F.coalesce(f"n_{k}", F.lit(0)) for k in CHECK_LABELS)
    own = counts.groupBy(*PAIR).agg(F.count("*").alias("_rows"), F.min(total).alias("_least"))
    met = own.join(annotations(oracle, evaluator), PAIR, "left")
    kinds = {"no_annotation": F.col("n_oracle").isNull(), "several_annotations": F.col("n_oracle") > 1, "repeated_pair": F.col("_rows") > 1, "no_label": F.col("_least") <= 0}
    return met.select(F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(k)) for k, bad in kinds.items())))).alias("kind"), *PAIR)


def _lead(p: list[str]) -> Column:
    """The side with the largest probability; tie if several have it."""
    top = F.greatest(*p)
    out = F.when(reduce(lambda a, b: a + b, ((F.col(c) == top).cast("int") for c in p)) > 1, MET[3])
    for c, name in zip(p, MET, strict=False):
        out = out.when(F.col(c) == top, name)
    return out


def calibrate(counts: DataFrame, oracle: DataFrame, split: str, evaluator: str | None = None, default: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """A row for each label: (label, p_support, p_refute, p_unknown, weight, majority_pairs, used_default, pair_count,
    met_support, met_refute, met_unknown, met_tie).

    A pair's labels weigh as much as their shares of its counts; a label's probabilities are the weighted means of the
    annotations. majority_pairs are the pairs that a label alone leads, met_* what their annotations say. A label that no pair
    has takes its default; without one it is an error, as are a pair that has no or several annotations or no label, no pair at
    all, and another split than the validation split."""
    if split != SPLIT:
        raise ValueError(f"labels are calibrated on the {SPLIT} split, not on {split}")
    counts = counts.select(*PAIR, *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in CHECK_LABELS))
    met = counts.join(oracle_index(oracle, evaluator).withColumn("_known", F.lit(1)), PAIR, "left")
    total = sum(F.col(f"n_{k}") for k in CHECK_LABELS)
    lost = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no annotation of "), _named(counts))).cast("long"))
    total = F.coalesce(lost, F.when(total > 0, total), F.raise_error(F.concat(F.lit("no label of "), _named(counts))).cast("long"))
    rows = met.select(*P, majority_label(counts).alias("_top"), _lead(P).alias("_met"), *((F.col(f"n_{k}") / total).alias(f"_w_{k}") for k in CHECK_LABELS))
    sums = [F.count("*").alias("_pairs")]
    for k in CHECK_LABELS:
        w, leads = F.col(f"_w_{k}"), F.col("_top") == k
        sums += [F.sum(w).alias(f"_m_{k}"), F.count(F.when(leads, 1)).alias(f"_n_{k}"), *(F.sum(w * F.col(c)).alias(f"_{c}_{k}") for c in P), *(F.count(F.when(leads & (F.col("_met") == m), 1)).alias(f"_{m}_{k}") for m in MET)]
    one = rows.agg(*sums)
    cells = []
    for k in CHECK_LABELS:
        seen, mass = F.col(f"_m_{k}") > 0, reduce(lambda a, b: a + b, (F.col(f"_{c}_{k}") for c in P))
        unseen = [F.lit(float(x)) for x in default[k]] if default else [F.raise_error(F.lit(f"label never seen: {k}")).cast("double")] * 3
        values = [F.when(F.col("_pairs") == 0, F.raise_error(F.lit("no pair to calibrate on")).cast("double")).when(seen, F.col(f"_{c}_{k}") / mass).otherwise(u).alias(c) for c, u in zip(P, unseen, strict=True)]
        cells.append(F.struct(F.lit(k).alias("label"), *values, F.coalesce(f"_m_{k}", F.lit(0.0)).alias("weight"), F.col(f"_n_{k}").alias("majority_pairs"), (~F.coalesce(seen, F.lit(False))).alias("used_default"), F.col("_pairs").alias("pair_count"), *(F.col(f"_{m}_{k}").alias(f"met_{m}") for m in MET)))
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def mapping_of(calibrated: DataFrame) -> dict[str, tuple[float, float, float]]:
    """calibrate()'s three rows as a mapping for relations_from_counts() and files.model_run()."""
    return {r["label"]: tuple(r[c] for c in P) for r in calibrated.select("label", *P).collect()}


def calibrated_relations(counts: DataFrame, calibrated: DataFrame, evaluator: str, reliability: float = 1.0) -> DataFrame:
    """Relations of label counts by a calibrated mapping; of any split."""
    return relations_from_counts(counts, mapping_of(calibrated), evaluator, reliability)
