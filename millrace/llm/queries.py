"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chat,
    clustering,
    decontaminate,
    jaccard,
    language_model,
    line_dedup,
    phrases,
    pieces,
    quality,
    sharding,
    simhash,
    sql,
    token_counts,
    topk,
)
from millrace.llm.common import fold, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"), learn=fold("doc_id") != 0)
    scored = quality.score_texts(documents, model)
    return scored.select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score_texts(table(spark, sf_dir, "documents"), learn=fold("doc_id") != 1)
    return scored.select(
        "doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations")).select(
        "conv_id", "n_turns", F.length("chat").cast("long").alias("n_chars"), F.md5("chat").alias("chat_md5")
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_and_check(documents, path, n=4)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents).select("doc_id", "text", F.to_json("removed_runs").alias("removed_runs"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024
    )


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=5, least=100, first=2000)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.lloyd(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64)


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_language_model,
        op3_chat_formatting,
        op4_sentencepiece,
        op5_sharding,
        op6_decontamination,
        op7_simhash,
        op8_line_dedup,
        op9_token_counts,
        op10_exact_topk,
        op11_phrases,
        op12_clusters,
        op13_jaccard,
    )
}

ORACLES: dict[str, str] = {
    "op10_exact_topk": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op3_chat_formatting": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
c AS (SELECT conv_id, list(role || chr(31) || text ORDER BY n) AS turns FROM o GROUP BY conv_id),
e AS (SELECT turns, min(conv_id) AS conv_id FROM c GROUP BY turns),
p AS (SELECT DISTINCT list_slice(turns, 1, m) AS turns
      FROM (SELECT turns, unnest(range(1, len(turns))) AS m FROM c)),
k AS (SELECT conv_id FROM e ANTI JOIN p ON e.turns = p.turns),
f AS (SELECT conv_id, count(*) AS n_turns,
             string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '<' || chr(8203) || '|im_start|>'),
                          '<|im_end|>', '<' || chr(8203) || '|im_end|>') || chr(10)
                        || replace(replace(text, '<|im_start|>', '<' || chr(8203) || '|im_start|>'),
                          '<|im_end|>', '<' || chr(8203) || '|im_end|>') || '<|im_end|>', chr(10) ORDER BY n) AS chat
      FROM o SEMI JOIN k USING (conv_id) GROUP BY conv_id)
SELECT conv_id, n_turns, CAST(length(chat) AS BIGINT) AS n_chars, md5(chat) AS chat_md5 FROM f
""",
    "op11_phrases": sql.phrases(longest=5, least=100, first=2000),
    "op12_clusters": sql.clusters(k=40, rounds=5, dim=64),
    "op13_jaccard": sql.jaccard(size=4, percent=85),
}
