"""The corpus pipeline: five stages, each over all that the one before kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, secrets, simhash
from tidemark.session import cut, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told by a clear margin; ``lang`` becomes the predicted one.

    Null and empty texts and texts without a letter are rejected, and so is
    every document if none has a language to learn from. Equal margins are
    narrow. Repeated rows are told each; long texts whole. Further columns of
    any name are carried along. No documents give none.
    """
    dictionaries = langid.learn(docs)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")  # one column, so no name can clash
    told = langid.identify(rows, dictionaries, keep=["row"]).where("accepted")
    return told.select(*[(F.col("lang_pred") if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in names])


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each near-duplicate group.

    Shingles of five words at a similarity of 0.8 or more. At 0.8 fingerprints
    of 256 bits differ in some 39 bits with a spread of 6, chance pairs in 128
    with a spread of 8. Links of up to 76 are looked at, which leaves room for
    short texts, and then held against the similarity of the texts: no clean
    document is lost to a chance resemblance. Null, empty and white texts are
    one group; a repeated id loses no other text; of rows alike in all columns
    one stays. Rows without id stay where their group has none. Long texts are
    compared whole. No documents give none.
    """
    return simhash.deduplicate(docs, radius=76, words=5, similarity=0.8, seeds=4)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, with secrets masked and ``n_chars`` counted anew where one was.

    Null and empty texts, repeated rows and further columns pass as they are;
    a null path is an unknown one. No documents give none.
    """
    clean = secrets.redact(docs, secrets.learn(docs))
    changed = F.coalesce(F.contains("text", F.lit(secrets.MASK)), F.lit(False))
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop whole documents so that the sources' words come near their targets.

    Null and empty texts count no words, null sources are one. Repeated rows
    are drawn one by one, ties go by a fixed order. No documents give none.
    """
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, with digests of ids and decoded bytes.

    Null and empty texts have no ids; copies are encoded each, long texts whole.
    No documents give none.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_deduplicated),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: Compression, fingerprints, the forest and the merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
