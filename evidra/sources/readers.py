"""Strict readers: an explicit schema, no inference, and an error that shows a bad line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.builders import qa_text
from evidra.sources import files

SAMPLE = (
    "sample_id string, question string, answer string, reference_answer string, claims array<struct<claim_id:string,text:string>>, "
    "contexts array<struct<doc_id:string,text:string,retrieval_score:double,reliability:double>>, gold_state string"
)
RELATION = "sample_id string, claim_id string, doc_id string, evaluator string, p_support double, p_refute double, p_unknown double, evaluator_reliability double"
RAGAS = "sample_id string, metric string, score double, granularity string, claim_id string"


class BadRecordError(ValueError):
    """Lines that are no record of the schema."""


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str], check: bool = True) -> DataFrame:
    """Rows of a JSON-lines file or folder. Blank lines are skipped; a path that doesn't exist is an error at once. With
    check, a line that doesn't parse, has an unknown key or lacks a required field is an error as it is read, without a
    pass of its own; bad_lines() lists such lines by their numbers."""
    parsed, wrong = _parsed(spark.read.text(path), schema, required)
    row = F.when(wrong, F.raise_error(F.concat(F.lit(f"{path}: not a valid record: "), F.substring("value", 1, 120))).cast(parsed.schema["r"].dataType)).otherwise(F.col("r")) if check else F.col("r")
    return parsed.select(row.alias("r")).select("r.*")


def _parsed(lines: DataFrame, schema: str, required: list[str]) -> tuple[DataFrame, Column]:
    """Lines with the record r of each, and whether one is wrong."""
    marked = F.startswith("value", F.lit("\ufeff"))  # no pattern: every line is looked at, in the filter and as it is parsed
    lines = lines.withColumn("value", F.when(marked, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))).filter(F.trim("value") != "")
    known = [f.name for f in lines.sparkSession.createDataFrame([], schema).schema]
    parsed = lines.select("*", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.json_object_keys("value").alias("keys"))
    wrong = F.col("r").isNull() | F.col("keys").isNull() | (F.size(F.array_except("keys", F.array(*map(F.lit, known)))) > 0)
    for c in required:
        wrong = wrong | F.col(f"r.{c}").isNull()
    return parsed, F.coalesce(wrong, F.lit(True))


def bad_lines(spark: SparkSession, path: str, schema: str, required: list[str], most: int = 3) -> list[tuple[str, int, str]]:
    """(file, line from 1, text) of the first wrong lines of each file. For reports: a file's lines are numbered in order."""
    kind = "file string, line long, value string"
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").rdd.map(tuple)
    # lines of a file lie in its partitions in order: numbers start where the partitions before end
    rows = spark.createDataFrame(lines.zipWithIndex().map(lambda x: (x[0][0], x[1], x[0][1])), kind)
    first = rows.groupBy("file").agg(F.min("line").alias("first"))
    parsed, wrong = _parsed(rows.join(first, "file"), schema, required)
    found = parsed.filter(wrong).orderBy("file", "line").limit(most).collect()
    return [(r["file"], r["line"] - r["first"] + 1, r["value"][:120]) for r in found]


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, SAMPLE, ["sample_id", "question", "answer", "claims", "contexts"])
    one = F.lit(1.0)
    return rows.withColumn("contexts", F.transform("contexts", lambda c: c.withField("reliability", F.coalesce(c["reliability"], one))))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, RELATION, ["sample_id", "claim_id", "doc_id", "evaluator", "p_support", "p_refute", "p_unknown"])
    return rows.withColumn("evaluator_reliability", F.coalesce("evaluator_reliability", F.lit(1.0)))


def read_ragas_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores by sample (granularity answer) or claim; a key that comes twice is an error."""
    rows = read_jsonl(spark, path, RAGAS, ["sample_id", "metric", "score", "granularity"])
    twice = rows.groupBy("sample_id", "metric", "claim_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise BadRecordError(f"{path}: {twice[0][:3]} comes twice")
    return rows


def claims_of(samples: DataFrame) -> DataFrame:
    """(sample_id, claim_id, claim_text, gold_state), one row a claim."""
    return samples.select("sample_id", F.explode("claims").alias("c"), "gold_state").select("sample_id", "c.claim_id", F.col("c.text").alias("claim_text"), "gold_state")


def contexts_of(samples: DataFrame) -> DataFrame:
    """(sample_id, doc_id, pos, reliability), in the order of the sample."""
    return samples.select("sample_id", F.posexplode("contexts").alias("pos", "c")).select("sample_id", "c.doc_id", "pos", "c.reliability")


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Predictions by method and claim; a claim that a method has twice is an error."""
    schema = "method string, sample_id string, claim_id string, predicted_label string, gold_label string, insufficiency_score double, conflict_score double, confidence double, correct int"
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if rows.groupBy("method", "sample_id", "claim_id").count().filter("count > 1").limit(1).count():
        raise BadRecordError(f"{path}: a claim comes twice")
    return rows


def read_qa_claims(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of claims with questions and answers, as (claim, label, text, source_url): a row for each answer, and one with
    null text for a claim without."""
    answer = "array<struct<answer:string,answer_type:string,boolean_explanation:string,source_url:string,source_medium:string>>"
    rows = spark.read.schema(f"claim string, label string, questions array<struct<question:string,answers:{answer}>>").option("multiLine", True).json(path)
    flat = rows.filter(F.trim("claim") != "").select("claim", "label", F.explode_outer("questions").alias("q")).select("claim", "label", F.col("q.question").alias("question"), F.explode_outer("q.answers").alias("a"))
    return flat.select("claim", "label", F.when(F.col("a").isNotNull(), qa_text(F.col("question"), F.col("a.answer"), F.col("a.boolean_explanation"))).alias("text"), F.col("a.source_url").alias("source_url"))


def read_fever(spark: SparkSession, path: str) -> DataFrame:
    """Annotated claims as builders.fever_samples() takes them."""
    evidence = "array<struct<evidence_id:string,evidence_label:string,article:string,evidence:string,entropy:double,votes:array<string>>>"
    return read_jsonl(spark, path, f"claim_id string, claim string, claim_label string, evidences {evidence}", ["claim_id", "claim", "claim_label", "evidences"])


def read_qa_source(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Splits of claims with questions (a JSON array each) as builders.qa_samples() takes them. A claim's index is its place
    in its array: a file is one record to Spark, so its rows come from one task in order."""
    answer = "array<struct<answer:string,answer_type:string,boolean_explanation:string,source_url:string,source_medium:string>>"
    kind = f"array<struct<claim:string,label:string,questions:array<struct<question:string,answers:{answer}>>>>"
    out = None
    for split, path in paths.items():
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json(F.regexp_replace("value", "^\ufeff", ""), kind)).alias("index", "r"))
        part = rows.select(F.lit(split).alias("source_split"), "index", "r.*")
        out = part if out is None else out.unionByName(part)
    return out


def answer_scores(scores: DataFrame, metric: str) -> DataFrame:
    """(sample_id, score) of a metric's scores of whole answers."""
    return scores.filter((F.col("metric") == metric) & (F.col("granularity") == "answer")).select("sample_id", "score")


def claim_scores(scores: DataFrame, metric: str) -> DataFrame:
    """(sample_id, claim_id, score) of a metric's scores of claims; answers' scores aren't dealt to claims."""
    return scores.filter((F.col("metric") == metric) & (F.col("granularity") == "claim") & F.col("claim_id").isNotNull()).select("sample_id", "claim_id", "score")


def score_granularities(scores: DataFrame) -> DataFrame:
    """(metric, granularities) that occur."""
    return scores.groupBy("metric").agg(F.array_sort(F.collect_set("granularity")).alias("granularities"))


def read_verified(spark: SparkSession, manifest_path: str, relations: str, evaluators: list[str], runs: str, splits: list[str]) -> tuple[DataFrame, DataFrame]:
    """The samples and relations of splits, each file checked against its manifests. relations and runs are paths with
    {split} and {evaluator} in them."""
    folder = manifest_path.rpartition("/")[0]
    manifest, found, rows = files.read_mapping(spark, manifest_path), None, None
    for split in splits:
        path = files.verify_artifact(spark, folder, manifest["splits"][split]["samples"])
        part = read_samples(spark, path)
        found = part if found is None else found.unionByName(part)
        for evaluator in evaluators:
            at = relations.format(split=split, evaluator=evaluator)
            files.verify_model_run(spark, runs.format(split=split, evaluator=evaluator), manifest_path, path, at, split)
            part = read_relations(spark, at)
            rows = part if rows is None else rows.unionByName(part)
    return found, rows
