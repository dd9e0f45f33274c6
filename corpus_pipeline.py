"""The training-data pipeline: five operators over `documents`, one after the other.

Each stage reads what its predecessor kept, from Parquet, and its decisions take effect: what
it rejects is gone, what it changes is changed. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import bpe, langid, lines, mixing, rows, simhash

RANKS = "byte_bpe_50k.tiktoken"
CACHED_CHARS = 2_500_000  # workers also hold what earlier stages left in them


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised; the model learns from the labels of `docs`."""
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a smaller id holds."""
    kept = lines.drop_repeated_lines(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, up to three times, so that sources balance."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document drawn, and a digest of the bytes that they decode to."""
    path = public_tokenizers.path(RANKS)
    coded = bpe.encode_documents(
        docs, path, public_tokenizers.PATTERN, cached_chars=CACHED_CHARS
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

# Fingerprints, trained predictions and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = rows.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
