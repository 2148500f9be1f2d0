"""Queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, pii, quality, simhash, token_counts, toxicity, url_filter, warc
from .common import table

BPE_VOCABULARY = "byte_bpe_50k.json"


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary=BPE_VOCABULARY)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


def held_out(key: str, parts: int, rest: int) -> Column:
    """Rows that training must not see: crc32 of the key as text leaves ``rest``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts == rest


def toxicity_model(documents: DataFrame, labels: DataFrame, config: toxicity.ToxicityConfig = toxicity.ToxicityConfig()) -> toxicity.ToxicityModel:
    texts, marks = toxicity.labelled_sample(documents, labels, "toxic", ~held_out("doc_id", 4, 2), "doc_id", "text", config.train_rows, config.train_bytes)
    return toxicity.train(texts, marks, config)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


TOXIC_FROM = 0.3
GOOD_FROM = 0.3


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, config = table(spark, sf_dir, "documents"), quality.QualityConfig()
    texts, marks = toxicity.labelled_sample(documents, table(spark, sf_dir, "labels"), "quality", ~held_out("doc_id", 5, 0), "doc_id", "text", config.train_rows, config.train_bytes)
    scored = quality.score_documents(documents, quality.train(texts, marks, config))
    out = F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out")
    return scored.select("doc_id", out, "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"), "n_bad_lines")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity_model(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(documents, model)
    out = F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out")
    return scored.select("doc_id", out, "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = F.size("hits").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_by_section(table(spark, sf_dir, "documents"), by="line", rule="first", vocabulary=BPE_VOCABULARY)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, body, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, CAST(i // 4 AS INT) * 5 + 1, 5))::INT >> (15 - 5 * CAST(i % 4 AS INT))) & 31) + 1, 1)), 'string_agg', '') AS digest FROM p
), g AS (SELECT body, min(page_id) AS original FROM p GROUP BY body)
SELECT page_id, CAST(strlen(d.body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM d JOIN g USING (body)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_personal_data": op6_personal_data,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_warc_revisits": op10_warc_revisits,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": OP4_SQL,
    "op10_warc_revisits": OP10_SQL,
}
