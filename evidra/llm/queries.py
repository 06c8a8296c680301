"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import bpe, chat, fingerprints, hard_negatives, language_id, minhash, ngram_join, packing, quality, sharding, topk, toxicity, whitening
from evidra.llm._shared import id_hash_mod, read_table, shared_dir


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(read_table(spark, sf_dir, "documents"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, id_hash_mod("doc_id", 5) != 0)
    scored = quality.score(docs.withColumn("held_out", id_hash_mod("doc_id", 5) == 0), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = topk.sign_codes(read_table(spark, sf_dir, "embeddings"))
    queries = codes.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return topk.hamming_top_k(codes, queries, 10)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chat(turns.unionByName(extra), path), path)


def op5_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), digest=True)


def op6_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    store = sharding.shard_documents(read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/evidra-shards-{uuid.uuid4().hex}")
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit(docs, id_hash_mod("doc_id", 4) != 2)
    labelled = language_id.label_spans(docs.withColumn("held_out", id_hash_mod("doc_id", 4) == 2), model, ["doc_id", "held_out"])
    return labelled.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, id_hash_mod("doc_id", 4) != 2)
    scored = toxicity.score(docs.withColumn("held_out", id_hash_mod("doc_id", 4) == 2), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=5, percent=85)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, components=16)
    explained = F.array(*map(F.lit, model.explained.tolist())) if len(model.explained) else F.array().cast("array<double>")
    each = whitening.transform(vectors, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "white"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("white").alias("whitened"),
        F.get(explained, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", wrong), F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_order_minhash, op2_quality_gam, op3_hamming_top_k, op4_chat_format, op5_lexical_packing, op6_size_tiered_shards,
        op7_byte_bpe, op8_ngram_jaccard, op9_language_id, op10_toxicity_ftrl, op11_minhash, op12_whitening, op13_hard_negatives,
    )
}

_CONTROL = r"(\\*)(### (?:System|User|Assistant): |</turn>|### <|>: )"

NEAR = r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < %(width)s THEN [array_to_string(w, ' ')]
                   ELSE list_distinct([array_to_string(w[i : i + %(width)s - 1], ' ') FOR i IN range(1, len(w) - %(width)s + 2)]) END AS s FROM words
        ), grams AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
        ), links AS (SELECT x, y FROM shared UNION SELECT y, x FROM shared),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
        , found AS (SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.y) AS component_id FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s)
"""

HARD = """
    WITH d AS (SELECT len(embedding) AS d FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
    v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
        FROM embeddings, d WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = d.d AND len([c FOR c IN embedding IF c IS NOT NULL AND isfinite(c)]) = d.d),
    s AS (SELECT DISTINCT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ORACLE_SQL = {
    "op3_hamming_top_k": """
        WITH v AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS b FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64),
        d AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum([CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END FOR x IN list_zip(q.b, v.b)])::BIGINT AS distance
              FROM v q, v WHERE q.vec_id % 20 = 0)
        SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::BIGINT AS rank, vec_id, distance FROM d) WHERE rank <= 10
    """,
    "op4_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), parts AS (
            SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
                   length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' ELSE '### <' || role || '>: ' END)
                   + length(regexp_replace(text, '{_CONTROL}', '\\1\\1\\\\\\2', 'g')) + length('</turn>') + 1 AS chars
            FROM turns
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(length(learned))::BIGINT AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
        FROM parts GROUP BY conv_id
    """,
    "op6_size_tiered_shards": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op8_ngram_jaccard": NEAR % {"width": 4} + "SELECT doc_id, n_shingles, component_id FROM found",
    "op11_minhash": NEAR % {"width": 5} + "SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM found",
    "op13_hard_negatives": HARD,
}
