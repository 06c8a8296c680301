"""Runs that a configuration describes: inputs, thresholds and outputs in one YAML or JSON file, relative paths below its folder.

Nothing in a configuration is guessed: unknown keys, values of a wrong kind and thresholds outside their range are errors before
any row is read. Outputs are written next to their places and put there once all of them are whole.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from numbers import Real

from pyspark.sql import DataFrame, SparkSession

from evidra.functions.gating import BaselineThresholds, Thresholds
from evidra.operators import baselines, fusion
from evidra.operators.tables import kept
from evidra.sources import files, readers, writers

# Keys of a configuration, and the fields that its thresholds are.
INPUTS, OUTPUTS = ("samples", "relation_predictions"), ("output_jsonl", "output_csv")
COMPRESSIONS = ("none", "gzip", "zstd")
DIAGNOSTICS = {"theta_threshold": "theta", "document_conflict_threshold": "document_conflict", "evaluator_conflict_threshold": "evaluator_conflict", "tie_tolerance": "tie"}
BASELINE = {"decision_threshold": "decision", "tie_tolerance": "tie", "conflict_threshold": "conflict", "conflict_margin": "margin"}


@dataclass(frozen=True)
class Run:
    """A configuration that has been read. baseline and evaluator are those of a run of baselines, else None."""

    paths: dict[str, str]
    gates: Thresholds
    baseline: BaselineThresholds | None
    evaluator: str | None
    overwrite: bool
    compression: str


def _section(path: str, config: dict, name: str, known: tuple[str, ...], needed: tuple[str, ...] = ()) -> dict:
    found = config.get(name, {})
    if not isinstance(found, dict):
        raise ValueError(f"{path}: {name} has to be a mapping")
    unknown, missing = sorted(set(map(str, found)) - set(known)), [k for k in needed if k not in found]
    if unknown or missing:
        raise ValueError(f"{path}: {name} has no key {unknown}" if unknown else f"{path}: {name} lacks {missing}")
    return found


def _thresholds(path: str, section: dict, fields: dict[str, str], kind: type):
    for key in fields:
        x = section.get(key, 0)
        if isinstance(x, bool) or not isinstance(x, Real) or math.isnan(x) or not 0 <= x <= 1:
            raise ValueError(f"{path}: {key} has to be a number within 0 and 1, not {x!r}")
    return kind(**{field: float(section[key]) for key, field in fields.items() if key in section})


def read_run(spark: SparkSession, path: str, baseline: bool = False) -> Run:
    """A configuration of a run of the pipeline, or of the baselines: sections paths, diagnostics or baseline, output."""
    config, own = files.read_mapping(spark, path), "baseline" if baseline else "diagnostics"
    unknown = sorted(set(map(str, config)) - {"paths", own, "output"})
    if unknown:
        raise ValueError(f"{path}: no such section {unknown}")
    paths = _section(path, config, "paths", (*INPUTS, *OUTPUTS), (*INPUTS, *OUTPUTS))
    bad = [k for k, v in paths.items() if not isinstance(v, str) or not v]
    if bad:
        raise ValueError(f"{path}: not a path {bad}")
    paths = {k: files.resolved(path, v) for k, v in paths.items()}
    if len(set(paths.values())) < len(paths):
        raise ValueError(f"{path}: two paths are the same")
    output = _section(path, config, "output", ("overwrite", "compression"))
    overwrite, compression = output.get("overwrite", False), output.get("compression", "none")
    if not isinstance(overwrite, bool):
        raise ValueError(f"{path}: overwrite has to be true or false")
    if compression not in COMPRESSIONS:
        raise ValueError(f"{path}: compression has to be one of {COMPRESSIONS}")
    section = _section(path, config, own, (*BASELINE, "single_evaluator") if baseline else tuple(DIAGNOSTICS), ("single_evaluator",) if baseline else ())
    evaluator = section.get("single_evaluator")
    if baseline and (not isinstance(evaluator, str) or not evaluator.strip()):
        raise ValueError(f"{path}: single_evaluator has to be a name")
    gates = Thresholds() if baseline else _thresholds(path, section, DIAGNOSTICS, Thresholds)
    base = _thresholds(path, section, BASELINE, BaselineThresholds) if baseline else None
    missing = [k for k in INPUTS if not files.exists(spark, paths[k])]
    if missing:
        raise FileNotFoundError(f"{path}: no such input {missing}")
    return Run(paths, gates, base, evaluator, overwrite, compression)


def _inputs(spark: SparkSession, run: Run) -> tuple[DataFrame, DataFrame]:
    """Samples, which claims, documents and texts are taken of, are parsed once; relations are read once."""
    return kept(readers.read_samples(spark, run.paths["samples"]), "samples"), readers.read_relations(spark, run.paths["relation_predictions"])


def _claims(samples: DataFrame) -> DataFrame:
    return readers.claims_of(samples).select(*fusion.CLAIM, "gold_state")


def _finish(spark: SparkSession, run: Run, overwrite: bool | None, rows, as_csv) -> DataFrame:
    """Writes rows() as JSON lines, and what as_csv makes of these as CSV, and returns what was written."""
    allowed = run.overwrite if overwrite is None else overwrite
    there = [run.paths[k] for k in OUTPUTS if files.exists(spark, run.paths[k])]
    if there and not allowed:
        raise FileExistsError(", ".join(there))
    staged = {k: f"{run.paths[k]}.{uuid.uuid4().hex}" for k in OUTPUTS}
    try:
        made = rows()
        writers.write_jsonl(made, staged["output_jsonl"], compression=run.compression)
        # the CSV file is made of what was written: rows are worked out once
        as_csv(spark.read.schema(made.schema).json(staged["output_jsonl"]), staged["output_csv"])
        for k in OUTPUTS:
            files.put_folder(spark, staged[k], run.paths[k], allowed)
    finally:
        for at in staged.values():
            files.delete(spark, at)
    return spark.read.schema(made.schema).json(run.paths["output_jsonl"])


def run_pipeline(spark: SparkSession, path: str, overwrite: bool | None = None) -> DataFrame:
    """Diagnoses all claims as a configuration says, writes them as JSON lines and flat CSV, and returns the rows that were
    written; fusion.summarise() counts them. overwrite: instead of the configuration's own. An existing output that may not be
    overwritten is an error before anything is worked out."""
    run = read_run(spark, path)

    def rows() -> DataFrame:
        samples, relations = _inputs(spark, run)
        evidence = fusion.nested_evidence(relations, samples)
        return writers.pipeline_rows(fusion.run_pipeline(_claims(samples), evidence, run.gates), samples)

    return _finish(spark, run, overwrite, rows, lambda df, at: writers.write_pipeline_csv(df, at, False, run.compression))


def run_baselines(spark: SparkSession, path: str, overwrite: bool | None = None) -> DataFrame:
    """As run_pipeline(), with the four baselines of a configuration with the section baseline."""
    run = read_run(spark, path, baseline=True)

    def rows() -> DataFrame:
        samples, relations = _inputs(spark, run)
        evidence = fusion.nested_evidence(relations, samples)
        return baselines.run_baselines(_claims(samples), evidence, run.baseline, run.evaluator)

    return _finish(spark, run, overwrite, rows, lambda df, at: writers.write_baseline_csv(df, at, run.evaluator, False, run.compression))
