"""Scalar functions on masses and scores, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# A checking model's labels in the order of its probabilities.
VERBAL_LABELS = ("Entailment", "Neutral", "Contradiction")


@dataclass(frozen=True)
class Thresholds:
    """Gates of the diagnosis; a value at a gate passes it."""

    theta: float = 0.5
    document_conflict: float = 0.4
    evaluator_conflict: float = 0.4
    tie: float = 1e-6


@dataclass(frozen=True)
class BaselineThresholds:
    decision: float = 0.5
    tie: float = 1e-6
    conflict: float = 0.3
    margin: float = 0.1


def unit(x: Column, slack: float = 1e-9) -> Column:
    """x with float noise of up to slack beyond 0 and 1 taken off; beyond that an error."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(F.abs(x - inside) <= slack, inside).when(x.isNull(), None).otherwise(F.raise_error(F.format_string("%s is not within 0 and 1", x)))


def reliability_of(x: Column) -> Column:
    """x, if it is a reliability: null, NaN and what isn't within 0 and 1 are an error."""
    return F.when(x.between(0, 1), x).otherwise(F.raise_error(F.format_string("%s is no reliability", x)).cast("double"))


def discounted(support: Column, refute: Column, reliability: Column) -> tuple[Column, Column, Column]:
    """Shafer's discount; what is taken off goes to the unassigned mass."""
    reliability = reliability_of(reliability)
    s, r = reliability * support, reliability * refute
    return s, r, 1 - s - r


def verdict(support: Column, refute: Column, tie: float | Column = 1e-6) -> Column:
    """The direction of a mass; within the tie band, undetermined."""
    return F.when(support - refute > tie, "supported").when(refute - support > tie, "refuted").otherwise("undetermined")


def gated_state(insufficient: Column, conflict: Column, direction: Column) -> Column:
    """The state of a claim; null if its direction is undetermined."""
    return F.when(conflict, "conflicting").when(insufficient, "insufficient").when(direction != "undetermined", direction)


def region(insufficient: Column, conflict: Column) -> Column:
    return (
        F.when(insufficient & conflict, "insufficient_and_conflicting").when(conflict, "document_conflict").when(insufficient, "insufficient").otherwise("sufficient_consistent")
    )


def metric_label(state: Column) -> Column:
    """The label of a state for metrics."""
    return F.coalesce(state, F.lit("undetermined"))


def fused_confidence(label: Column, support: Column, refute: Column, theta: Column, k_doc: Column) -> Column:
    """Confidence in a label from what speaks for it; undefined masses count as 0."""
    chosen = F.when(label == "supported", support).when(label == "refuted", refute).when(label == "insufficient", theta).when(label == "conflicting", k_doc)
    return F.coalesce(chosen, F.lit(0.0))


def baseline_confidence(label: Column, support: Column, refute: Column, unknown: Column) -> Column:
    """As fused_confidence(), from scores; a conflict is as sure as the weaker of its sides."""
    return fused_confidence(label, support, refute, unknown, F.least(support, refute))


def vote(support: Column, refute: Column, unknown: Column) -> Column:
    """The largest of three probabilities; any exact tie for the first place is unknown."""
    top = F.greatest(support, refute, unknown)
    ties = sum((x == top).cast("int") for x in (support, refute, unknown))
    return F.when(ties > 1, "unknown").when(support == top, "supported").when(refute == top, "refuted").otherwise("unknown")


def unique_argmax(p: dict[str, Column], tie: float = 1e-9) -> Column:
    """The name whose probability leads by more than tie, else null."""
    best = F.greatest(*p.values())
    top = F.when(sum((best - x <= tie).cast("int") for x in p.values()) > 1, F.lit(None).cast("string"))
    for name, x in p.items():
        top = top.when(best - x <= tie, name)
    return top


def directional_vote(support: Column, refute: Column, unknown: Column) -> Column:
    """1, -1 or 0: a side wins over a tied unknown, not over a tied other side."""
    top = F.greatest(support, refute, unknown)
    return F.when((support == top) & (refute != top), 1).when((refute == top) & (support != top), -1).otherwise(0)


def baseline_decision(support: Column, refute: Column, unknown: Column, t: BaselineThresholds, decision: Column | None = None) -> tuple[Column, Column]:
    """(state, reason) of weighted scores; null scores are no evidence."""
    top = F.greatest(support, refute, unknown)
    near = sum((top - x <= t.tie).cast("int") for x in (support, refute, unknown))
    reason = (
        F.when(support.isNull(), "no_evidence").when(top < (decision if decision is not None else F.lit(t.decision)), "below_threshold").when(near > 1, "score_tie").when(unknown == top, "unknown_highest").otherwise("decided")
    )
    state = F.when(reason != "decided", "insufficient").when(support == top, "supported").otherwise("refuted")
    return state, reason


def conflict_rule(support: Column, refute: Column, conflict: float | Column, margin: float | Column) -> Column:
    """Both sides are strong and close to each other."""
    return (F.least(support, refute) >= conflict) & (F.abs(support - refute) <= F.lit(margin) + 1e-12)
