"""Small files beside the data (manifests, configurations), on any file system that Spark reads."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def matching(spark: SparkSession, pattern: str) -> int:
    """How many files a pattern finds."""
    fs, at = _fs(spark, pattern)
    return len(fs.globStatus(at) or [])


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A whole file, put in place by a rename; an existing one is an error unless it may be overwritten. Then the new file takes
    its name in one step (FileContext's rename), so a crash leaves the one or the other."""
    fs, at = _fs(spark, path)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(path)
    new = at.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if overwrite:
            _replace(spark, fs.makeQualified(new), fs.makeQualified(at))
        elif not fs.rename(new, at):
            raise FileExistsError(path)
    finally:
        fs.delete(new, False)


def _replace(spark: SparkSession, new, at) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(new, at, options)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder, if it is there."""
    fs, at = _fs(spark, path)
    return fs.delete(at, True)


def put_folder(spark: SparkSession, staged: str, path: str, overwrite: bool = False) -> None:
    """Gives a folder that is whole its place. What was there is moved aside first and deleted last, so that a crash loses
    neither: at worst the former one lies beside its place, under its name and .former."""
    fs, new = _fs(spark, staged)
    at, former = fs.makeQualified(_fs(spark, path)[1]), fs.makeQualified(_fs(spark, f"{path}.former")[1])
    if fs.exists(at):
        if not overwrite:
            raise FileExistsError(path)
        fs.delete(former, True)
        if not fs.rename(at, former):
            raise OSError(f"{path} can't be moved")
    fs.mkdirs(at.getParent())
    if not fs.rename(new, at):
        raise OSError(f"{staged} can't be moved to {path}")
    fs.delete(former, True)


def delete_others(spark: SparkSession, folder: str, prefix: str, keep: str) -> int:
    """Deletes the folders below folder whose names begin with prefix, but keep; and returns their number."""
    fs, at = _fs(spark, folder)
    others = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix) and s.getPath().getName() != keep]
    return sum(bool(fs.delete(p, True)) for p in others)


def read_mapping(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON file whose top level is a mapping."""
    text = read_text(spark, path)
    try:
        import yaml

        found = yaml.safe_load(text)
    except ModuleNotFoundError:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: the top level has to be a mapping")
    return found


def resolved(base: str, path: str) -> str:
    """path, or if it is relative, below the folder of the file base."""
    return path if "://" in path or path.startswith("/") else f"{base.rpartition('/')[0] or '.'}/{path}"


def read_config(spark: SparkSession, path: str, inputs: tuple[str, ...] = ("samples", "relations"), outputs: tuple[str, ...] = ("output",)) -> dict:
    """A configuration; the paths under its key paths are resolved against its folder, and inputs that don't exist are an
    error."""
    config = read_mapping(spark, path)
    paths = {k: resolved(path, v) for k, v in config.get("paths", {}).items()}
    missing = [k for k in inputs if k in paths and not exists(spark, paths[k])]
    unset = [k for k in (*inputs, *outputs) if k not in paths]
    if missing or unset:
        raise ValueError(f"{path}: no such input {missing}" if missing else f"{path}: paths lacks {unset}")
    return config | {"paths": paths}


def artifact(spark: SparkSession, path: str) -> dict:
    """Digest and number of non-blank lines of a file, or of a folder of files by their names. A task has a file whole in
    memory: see writers.FILE_LINES."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"))
    every = files.agg(F.array_sort(F.collect_list(F.struct("name", "sha"))).alias("x")).select(F.when(F.size("x") == 1, F.col("x")[0]["sha"]).otherwise(F.sha2(F.array_join(F.transform("x", lambda f: f["sha"]), ""), 256))).first()[0]
    return {"path": os.path.basename(path.rstrip("/")), "sha256": every, "records": spark.read.text(path).filter(F.trim("value") != "").count()}


def same(a: dict | None, b: dict | None) -> bool:
    """Whether two artifacts have the same content, wherever they lie."""
    return a is not None and b is not None and all(a[k] == b[k] for k in ("sha256", "records"))


def verify_artifact(spark: SparkSession, folder: str, expected: dict) -> str:
    """The path of an artifact that is what a manifest says; else an error."""
    path = f"{folder.rstrip('/')}/{expected['path']}"
    found = artifact(spark, path)
    if not same(found, expected):
        raise ValueError(f"{expected['path']} isn't what the manifest says: {found}")
    return path


def dataset_manifest(name: str, source: dict, seed: int, counts: dict[str, int], labels: dict[str, str], splits: dict[str, dict], warning: str = "") -> dict:
    """splits: of each split its artifacts (samples, and relation_predictions or None)."""
    if set(splits) != set(counts):
        raise ValueError("splits and counts don't name the same splits")
    oracle = {bool(s.get("relation_predictions")) for s in splits.values()}
    if len(oracle) > 1:
        raise ValueError("either all splits have relations or none")
    kind = "annotation_oracle" if oracle == {True} else "none"
    return {"schema_version": "1.0", "dataset_name": name, "source": source, "random_seed": seed, "per_class": sum(counts.values()), "split_per_class": counts, "label_mapping": labels, "relation_predictions_kind": kind, "relation_predictions_warning": warning, "splits": splits}


def verify_split(spark: SparkSession, manifest_path: str, samples: str, relations: str | None, split: str) -> None:
    """An error unless the files are those that the manifest has for a split."""
    own = read_mapping(spark, manifest_path)["splits"][split]
    for kind, path in (("samples", samples), ("relation_predictions", relations)):
        if path is not None and not same(own.get(kind), artifact(spark, path)):
            raise ValueError(f"{path} isn't the manifest's {kind} of {split}")


MAPPING_SOURCES = ("default", "calibrated_on_validation", "continuous_probabilities", "custom")


def model_run(spark: SparkSession, dataset: str, split: str, evaluator: str, producer: str, checker: str, samples: dict, relations_path: str, source_path: str, mapping: dict, mapping_source: str, calibration: str | None = None, reliability: float = 1.0, **more) -> dict:
    """What a relation file was made from and how."""
    if mapping_source not in MAPPING_SOURCES or (mapping_source == "calibrated_on_validation") != bool(calibration):
        raise ValueError("a calibrated mapping needs its calibration, and no other may have one")
    if not 0 <= reliability <= 1:
        raise ValueError("a reliability is within 0 and 1")
    made = artifact(spark, relations_path)
    return {
        "schema_version": "1.0", "dataset_name": dataset, "split": split, "relation_predictions_kind": "model_prediction", "evaluator": evaluator, "producer": producer, "checker_name": checker, "samples": samples,
        "relation_predictions": made, "source_output": made if source_path == relations_path else artifact(spark, source_path), "label_mapping": mapping, "label_mapping_source": mapping_source, "calibration_path": calibration, "evaluator_reliability": reliability, **more,
    }


def verify_model_run(spark: SparkSession, run_path: str, manifest_path: str, samples: str, relations: str, split: str) -> dict:
    """A model run whose relation file, samples and dataset are what it says; else an error."""
    run, manifest = read_mapping(spark, run_path), read_mapping(spark, manifest_path)
    own = manifest["splits"][split]["samples"]
    wrong = [k for k, right in (
        ("dataset_name", run["dataset_name"] == manifest["dataset_name"]), ("split", run["split"] == split), ("samples", same(run["samples"], artifact(spark, samples))), ("dataset's samples", same(own, run["samples"])),
        ("relation_predictions", same(run["relation_predictions"], artifact(spark, relations))),
    ) if not right]
    if wrong:
        raise ValueError(f"{run_path}: {', '.join(wrong)} differ")
    return run


def write_manifest(spark: SparkSession, manifest: dict, path: str, overwrite: bool = False) -> None:
    write_text(spark, path, json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True), overwrite)
