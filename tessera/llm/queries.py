"""Registered queries of the training-data operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, language, licenses, lines, mixing, sharding, simhash, topk, urls
from tessera.llm.common import table


def op1_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    named = language.identify(docs, language.fit(docs))
    held_out = F.coalesce(~language.is_learned(F.col("doc_id")), F.lit(False))
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents"))


def op3_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mixing.taken(docs, weight=mixing.learned_weight(docs, table(spark, d, "labels")))


def op4_exact_top_k(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % topk.STEP == 0)


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    gone = lines.repeated_lines(table(spark, d, "documents"))
    return gone.select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", ",").alias("lines"))


def op6_chat_perspectives(spark: SparkSession, d: str) -> DataFrame:
    return chat.rotate(table(spark, d, "conversations"))


def op7_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op8_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return urls.judge(pages, urls.page_outcomes(pages))


def op9_simhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op10_rendezvous_shards(spark: SparkSession, d: str) -> DataFrame:
    return sharding.assign(table(spark, d, "documents"))


OPERATORS = (op1_language_id, op2_license_scan, op3_mix_sources, op4_exact_top_k, op5_line_dedup, op6_chat_perspectives, op7_decontaminate, op8_url_filter, op9_simhash_dedup, op10_rendezvous_shards)

TOP_K_SQL = """WITH f AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  e AS (SELECT r, vec_id, generate_subscripts(v, 1) AS i, CAST(floor(64 * unnest(v)) AS BIGINT) AS x, len(v) AS n FROM f
    WHERE len(list_filter(v, lambda x: abs(x) * 64 >= 2147483648.0 / sqrt(len(v)))) = 0),
  s AS (SELECT q.r, q.vec_id AS query_id, c.r AS other, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM e q JOIN e c ON q.i = c.i AND q.n = c.n
    WHERE q.vec_id % 20 = 0 AND q.r <> c.r GROUP BY ALL),
  r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.scan_sql(),
        "op4_exact_top_k": TOP_K_SQL,
        "op5_line_dedup": lines.repeated_lines_sql(),
        "op6_chat_perspectives": chat.rotate_sql(),
        "op8_url_filter": urls.judge_sql(),
    }
