"""One query per operator on its whole table, and SQL where it can express the operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import stage
from . import (
    byte_bpe,
    conversation_repair,
    jpeg_media,
    kneser_ney,
    license_lookup,
    license_texts,
    near_dedup,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_formats,
    url_rules,
    warc,
)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int) -> str:
    """SQL for the fold of a document: crc32 of its number as text; NULL numbers are in fold 0."""
    return f"coalesce(crc32(CAST(CAST({key} AS STRING) AS BINARY)) % {n}, 0)"


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.apply_rules(docs, labels)


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = remainder("doc_id", 5)
    weights = quality_classifier.train(docs, labels, learn=f"{fold} <> 0")
    return quality_classifier.classify(docs, weights).select(
        "doc_id", F.expr(f"{fold} = 0").alias("held_out"), "score", "predicted"
    )


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = f"{remainder('doc_id', 10)} = 0"
    return kneser_ney.score_texts(table(spark, sf_dir, "documents"), held)


URL_RULES = [
    url_rules.Rule("com", "/en/", "block"),
    url_rules.Rule("example.com", "/en/7", "allow"),
    url_rules.Rule("net", "/de/", "allow"),
    url_rules.Rule("example.net", "/de/8", "block"),
    url_rules.Rule("org", "/es/", "block"),
]


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stage(jpeg_media.store_media(table(spark, sf_dir, "documents")), "media")
    read = jpeg_media.media_features(stored)
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash", F.substring("thumbnail_sha256", 1, 16))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stage(warc.write_archives(table(spark, sf_dir, "pages")), "archives")
    normal = stage(warc.normalise(archives), "normal-archives")
    number = F.expr("CAST(nullif(page, '') AS BIGINT)")
    return warc.read_records(normal, payload=False).select(
        number.alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers").cast("long").alias("refers_to"),
    )


def packed_documents(docs: DataFrame) -> DataFrame:
    """Place and id digest of every piece; the ids themselves are not moved."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = byte_bpe.BpeFiles(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), files)
    digests = encoded.select("doc_id", "ids", byte_bpe.count().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    decoded = byte_bpe.decode(digests, files)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_license_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(license_texts.LICENSES, "license_id string, text string")
    return license_lookup.find_licenses(table(spark, sf_dir, "documents"), known)


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """The rows with planted faults; ``times`` tells how often a row stands there."""
    code = F.expr("crc32(CAST(concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' ')) AS BINARY)) % 20")
    text = F.coalesce("text", F.lit(" "))
    return rows.withColumn("_code", code).select(
        "conv_id",
        "turn",
        F.when(F.col("_code") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("_code") == 0, 0).when(F.col("_code") == 3, 2).otherwise(1).alias("times"),
    )


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = damaged_conversations(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_digests(damaged, times="times")


WORDS = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the checksum of its number, repeats a stretch of its words to its end."""
    h = F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY))")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("_h"))
    rows = rows.withColumn("_g", F.expr("_h DIV 10")).withColumn("_w", F.expr(f"CASE WHEN _h % 10 = 0 THEN {WORDS} END"))
    rows = rows.withColumn("_a", F.expr("CASE WHEN size(_w) > 0 THEN CAST(_g % size(_w) AS INT) END"))
    rows = rows.withColumn("_p", F.expr("CAST(1 + (size(_w) - _a) DIV (3 + _g % 8) AS INT)"))
    tail = F.expr("transform(sequence(0, size(_w) - 1), i -> _w[IF(i < _a, i, _a + (i - _a) % _p)])")
    changed = F.when(F.col("_a").isNotNull(), F.concat_ws(" ", tail)).otherwise(F.col("text"))
    return rows.select("doc_id", changed.alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(repeated_tails(table(spark, sf_dir, "documents")))


@query
def op13_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_formats.find_secrets(docs, secret_formats.fit(docs))
    listed = "array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = F.expr(listed.format(spans="filter(spans, s -> s.base)"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(base, 256).alias("base_sha256"),
        F.expr(listed.format(spans="spans")).alias("spans"),
    )


LLM_QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

LLM_ORACLE["op5_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM p
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM f
"""
