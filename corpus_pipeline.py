"""From raw documents to packed token sequences, in four written stages.

Each stage reads what its predecessor kept; every stage but the last returns the columns of
``documents``. Statistics and thresholds are those of the stage's own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm import near_dedup, packing, quality_classifier, quality_rules
from stormgrid.session import stage

# The classifier and the near-duplicate classes have no SQL form.
ORACLE_SQL = None


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, labels_of(spark, sf_dir))


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fold = "coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5, 0)"
    weights = quality_classifier.train(docs, labels_of(spark, sf_dir), learn=f"{fold} <> 0")
    return quality_classifier.keep_predicted(docs, weights)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("near_dedup", remove_near_duplicates),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents which all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
