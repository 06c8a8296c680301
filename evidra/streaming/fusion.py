"""Fusion of an append-only stream of relations. The state of a claim and evaluator is a few sums."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evidra.operators.fusion import GROUP, fuse_documents


def streaming_fusion(evidence: DataFrame) -> DataFrame:
    """fuse_documents() over a stream of evidence rows, for output mode update or complete: a claim's masses as of the
    relations so far. Sums of logarithms don't depend on the order of arrival; repeated rows count again, so drop them upstream
    with a watermark if the source may repeat."""
    return fuse_documents(evidence, GROUP)
