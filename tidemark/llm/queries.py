"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, crosstok, dialogue, fertility, langid, lines, mixing, quality, secrets, shard, simhash, topk
from tidemark.llm.common import remainder
from tidemark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of three quarters of the ids."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    field = quality.learn(docs, labels.where(~held_out))
    return quality.score(docs, field).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of all documents with the verdict of the forest."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by 3-word shingles, 2 bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, words=3)


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from the perspective of each participant, with masks."""
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op6_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector among all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64, every=20)


def op7_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, dictionaries).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted"
    )


def op8_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes over all documents."""
    return shard.assign(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole text, there and back."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of tokeniser fertility for all documents."""
    ranks, pieces = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    return fertility.judge(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, pieces)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten code points and more that stand in two documents, dropped from all but the first."""
    left = lines.deduplicate_lines(table(spark, sf_dir, "documents"), min_docs=2, min_chars=10)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule, and their cheapest repair."""
    return dialogue.repaired(dialogue.damaged(table(spark, sf_dir, "conversations")), copies_col="copies")


def op13_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text in two vocabularies, aligned through distinct segments."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return crosstok.align(table(spark, sf_dir, "documents"), *paths)


def queries() -> dict[str, Query]:
    return {
        "op1_crf_quality": op1_crf_quality,
        "op2_secret_forest": op2_secret_forest,
        "op3_pareto_mix": op3_pareto_mix,
        "op4_simhash_tiles": op4_simhash_tiles,
        "op5_perspectives": op5_perspectives,
        "op6_va_file": op6_va_file,
        "op7_zstd_language": op7_zstd_language,
        "op8_sampled_splitters": op8_sampled_splitters,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_fertility": op10_fertility,
        "op11_line_dedup": op11_line_dedup,
        "op12_turn_repair": op12_turn_repair,
        "op13_segment_alignment": op13_segment_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_pareto_mix": mixing.SQL, "op5_perspectives": chat.SQL, "op6_va_file": topk.SQL, "op11_line_dedup": lines.SQL, "op12_turn_repair": dialogue.SQL}
