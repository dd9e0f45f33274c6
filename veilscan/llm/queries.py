"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import (
    archive,
    automaton,
    bpe,
    compression,
    counts,
    fim,
    langid,
    lines,
    mixing,
    rows,
    simhash,
    token_files,
    topk,
    whitening,
)

LIBRARY_TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
END_ID = 2


def _table(folder: str, name: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _table(sf_dir, "documents", spark), rows.new_folder(spark, "tokens")
    path = public_tokenizers.path(LIBRARY_TOKENIZER)
    token_files.write_token_files(docs, folder, path, END_ID)
    return token_files.read_token_files(spark, folder)


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(_table(sf_dir, "documents", spark))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = _table(sf_dir, "documents", spark)
    return bpe.encoding_digests(docs, path, public_tokenizers.PATTERN)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_MODEL)
    return counts.token_counts(_table(sf_dir, "documents", spark), path)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(sf_dir, "embeddings", spark)
    return topk.nearest(vectors, F.col("vec_id") % 100 == 0, k=10)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(sf_dir, "documents", spark)
    found, language = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), f"{language}.*")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(sf_dir, "documents", spark))
    return found.select(
        "doc_id",
        simhash.as_hex(F.col("print")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = rows.new_folder(spark, "archive")
    archive.write_archive(_table(sf_dir, "pages", spark), folder)
    return archive.read_archive(spark, folder)


def op9_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(sf_dir, "documents", spark)
    planned, mixed = mixing.planned_draws(docs, keep=False)
    return planned.select("doc_id", f"{mixed}.*").select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.size("draws")).cast("long").alias("taken"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_repeated_lines(_table(sf_dir, "documents", spark))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return done.select("doc_id", "n_lines", "n_dropped", digest)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_table(sf_dir, "documents", spark))
    again = fim.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(again.cast("binary"), 256).alias("restored_sha256"),
    )


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_TOKENIZER)
    coded = automaton.encode_documents(_table(sf_dir, "documents", spark), path)
    decimals = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimals.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whiten(_table(sf_dir, "embeddings", spark))
    return done.withColumn("deviation", F.col("deviation").cast("long"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_compression_bands": op2_compression_bands,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_token_counts": op4_token_counts,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_language_id": op6_language_id,
        "op7_simhash_groups": op7_simhash_groups,
        "op8_content_archive": op8_content_archive,
        "op9_weighted_mix": op9_weighted_mix,
        "op10_line_dedup": op10_line_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_bpe_automaton": op12_bpe_automaton,
        "op13_embedding_whitening": op13_embedding_whitening,
    }
