"""The corpus pipeline: language ID, toxicity, near duplicates, packing. Each stage works on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra import ship
from evidra.llm import language_id, ngram_join, packing, toxicity
from evidra.llm._shared import dropped, id_hash_mod, read_table, written
from evidra.llm.queries import vocabulary

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if less than this share of its words is in its main language, or if it has no letter.
LEAST_LANGUAGE_SHARE = 0.5
#: A document goes if its toxicity is this or more.
TOXIC = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose main language has at least half of their words. Null and empty texts, and those
    without a letter, go; repeated rows are judged alike; an empty table stays empty; with nothing to learn from all go."""
    model = language_id.fit(docs, id_hash_mod("doc_id", 4) != 2)
    labelled = language_id.label_spans(docs, model, list(COLUMNS))
    return labelled.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. Null and empty texts score as the model's bias does; repeated rows
    are judged alike; without labels nothing is rejected; an empty table stays empty."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), id_hash_mod("doc_id", 4) != 2)
    scored = toxicity.score(docs, model, list(COLUMNS))
    return scored.filter(F.col("score") < TOXIC).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates; of rows that repeat its id and text, one. Documents
    without a word are near nothing and stay; so do rows with a null id whose group has no id; an empty table stays empty."""
    groups = written(ngram_join.near_duplicates(docs), "groups")
    return ngram_join.representatives(docs.select(*COLUMNS), groups)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences. A null text is its closing id alone; repeated rows are packed each; an empty
    table gives no rows."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), digest=True)


STAGES = [("language_id", known_language), ("toxicity", not_toxic), ("near_duplicates", one_of_each), ("packing", packed)]

#: Learned models and BPE are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, made = read_table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            dropped(*made)
            made = [docs]
    return docs
