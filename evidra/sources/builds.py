"""Datasets of several tables that appear all at once.

A build writes its tables into a folder of its own below the dataset's folder, under a version that nothing reads, and puts
the manifest in place last. The manifest names the version's files with their digests, so a build that dies leaves the former
manifest and its files; the next build takes a new version. Former versions stay until prune() is called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import builders
from evidra.sources import files, readers, writers

KINDS = ("samples", "relation_predictions", "provenance")


def publish(spark: SparkSession, folder: str, tables: dict[str, dict[str, DataFrame]], name: str, source: dict, seed: int, counts: dict[str, int], labels: dict[str, str], warning: str = "", overwrite: bool = False, compression: str = "none") -> dict:
    """Writes tables (split: kind: rows) as a version of the dataset in folder, and its manifest. An existing dataset is an error
    unless it may be followed by a new version."""
    manifest_path = f"{folder}/manifest.json"
    if files.exists(spark, manifest_path) and not overwrite:
        raise FileExistsError(manifest_path)
    version, splits = f"v-{uuid.uuid4().hex}", {}
    for split, of in tables.items():
        own: dict = {"relation_predictions": None}
        for kind in KINDS:
            if kind not in of:
                continue
            path = f"{version}/{split}_{kind}"
            write = {"samples": writers.write_samples, "relation_predictions": writers.write_relations}.get(kind, writers.write_jsonl)
            write(of[kind], f"{folder}/{path}", **({} if compression == "none" else {"compression": compression}))
            own[kind] = files.artifact(spark, f"{folder}/{path}") | {"path": path}
        states = of["samples"].groupBy("gold_state").agg(F.count("*").alias("n")).orderBy("gold_state").collect()
        splits[split] = own | {"label_counts": {r["gold_state"]: r["n"] for r in states}}
    manifest = files.dataset_manifest(name, source, seed, counts, labels, splits, warning) | {"version": version}
    files.write_manifest(spark, manifest, manifest_path, overwrite)
    return manifest


def read_build(spark: SparkSession, folder: str, split: str, kind: str = "samples") -> DataFrame:
    """A table of the published version, checked against the manifest."""
    manifest = files.read_mapping(spark, f"{folder}/manifest.json")
    expected = manifest["splits"][split][kind]
    if expected is None:
        raise ValueError(f"{manifest['dataset_name']} has no {kind}")
    path = f"{folder}/{expected['path']}"
    found = files.artifact(spark, path)
    if (found["sha256"], found["records"]) != (expected["sha256"], expected["records"]):
        raise ValueError(f"{expected['path']} isn't what the manifest says")
    return {"samples": readers.read_samples, "relation_predictions": readers.read_relations}.get(kind, lambda s, p: s.read.json(p))(spark, path)


def prune(spark: SparkSession, folder: str) -> int:
    """Deletes the versions that the manifest doesn't name, and returns how many these were. Not while a build runs."""
    return files.delete_others(spark, folder, "v-", files.read_mapping(spark, f"{folder}/manifest.json")["version"])


def _split(rows: DataFrame, counts: dict[str, int]) -> dict[str, DataFrame]:
    return {split: rows.filter(F.col("split") == split) for split in counts}


def _source(spark: SparkSession, name: str, paths: list[str], records: int, **more) -> dict:
    return {"name": name, "files": [files.artifact(spark, p) for p in paths], "raw_records": records, **more}


def build_votes(spark: SparkSession, source: str, folder: str, counts: dict[str, int], name: str, seed: int = 42, overwrite: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df, **more) -> dict:
    """A dataset of annotated claims with votes (readers.read_fever()): balanced splits, samples, relations of the votes, and
    provenance. keep: what makes the split rows a table (as operators.tables.kept), so that they are drawn once."""
    rows = readers.read_fever(spark, source)
    drawn = keep(builders.balanced_split(rows, "claim", "claim_label", F.col("claim_id").cast("long"), counts, seed))
    tables = {s: {"samples": builders.fever_samples(df), "relation_predictions": builders.vote_relations(df), "provenance": builders.fever_provenance(df)} for s, df in _split(drawn, counts).items()}
    warning = "relations are shares of human votes: an upper bound, no model's output"
    return publish(spark, folder, tables, name, _source(spark, "annotated claims with votes", [source], rows.count(), **more), seed, counts, builders.FEVER_STATES, warning, overwrite)


def build_questions(spark: SparkSession, sources: dict[str, str], folder: str, counts: dict[str, int], name: str, seed: int = 42, overwrite: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df, **more) -> dict:
    """A dataset of claims with questions and answers (readers.read_qa_source()): balanced splits, samples and provenance; no
    relations. Of equal claims the first counts, by the order of sources and place."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source_split")) * (1 << 40) + F.col("index")
    rows = readers.read_qa_source(spark, sources).filter(F.length(F.trim("claim")) > 0)
    drawn = keep(builders.balanced_split(rows, "claim", "label", place, counts, seed))
    tables = {s: {"samples": builders.qa_samples(df), "provenance": builders.qa_provenance(df)} for s, df in _split(drawn, counts).items()}
    return publish(spark, folder, tables, name, _source(spark, "claims with questions", list(sources.values()), rows.count(), **more), seed, counts, builders.QA_STATES, "", overwrite)


def build_web(spark: SparkSession, claims: DataFrame, pages: DataFrame, media: DataFrame, values: dict[str, float], unrated: float, folder: str, name: str, source: dict, overwrite: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df, **windowing) -> dict:
    """A dataset of claims (sample_id, text, gold_state) with a passage of each of their pages (builders.web_contexts()), as one
    split named all: samples whose contexts have the reliability of their source's credibility, and provenance."""
    contexts = keep(builders.web_contexts(claims.select("sample_id", "text"), pages, media, values, unrated, **windowing))
    one = F.struct("pos", "doc_id", "text", "reliability", "url", "domain", "credibility", "passage", "passages")
    by = claims.join(contexts.groupBy("sample_id").agg(F.array_sort(F.collect_list(one)).alias("x")), "sample_id", "left").withColumn("x", F.coalesce("x", F.array()))
    context = F.transform("x", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["text"].alias("text"), F.lit(None).cast("double").alias("retrieval_score"), c["reliability"].alias("reliability")))
    claim = F.array(F.struct(F.concat("sample_id", F.lit("-c1")).alias("claim_id"), F.trim("text").alias("text")))
    samples = by.select("sample_id", builders.asked(F.trim("text")).alias("question"), F.trim("text").alias("answer"), F.lit(None).cast("string").alias("reference_answer"), claim.alias("claims"), context.alias("contexts"), "gold_state")
    provenance = by.select("sample_id", F.lit(name).alias("source_dataset"), F.transform("x", lambda c: F.struct(*(c[k].alias(k) for k in ("doc_id", "url", "domain", "credibility", "passage", "passages")))).alias("contexts"))
    return publish(spark, folder, {"all": {"samples": samples, "provenance": provenance}}, name, source, 0, {"all": 0}, {}, "", overwrite)
