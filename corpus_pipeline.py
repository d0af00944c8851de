"""A training-text pipeline over the documents table: five stages, each written and read again.

Stages take (spark, docs, sf_dir) and give the columns of ``documents``; the last gives the
packed pieces. Row order means nothing; repeated rows are rows of their own, except that the
third stage keeps one row of each group.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import common, decontaminate, langid, lines, packing, simhash
from tidemark.session import store

#: Shingles of the near-duplicate stage, as of all stages on word shingles.
SHINGLE_WORDS = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; texts that are null, without a letter or between languages go."""
    common.prepare(spark)
    model = langid.fit(docs)
    found = langid.predict(F.col("text"), model)
    told = "language told by the first stage"  # no column of documents is called so
    return docs.withColumn(told, found).filter(
        (F.col(f"`{told}`.lang") != langid.UNKNOWN) & ~F.col(f"`{told}`.ambiguous")).drop(told)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; ``n_chars`` follows the text."""
    common.prepare(spark)
    kept = lines.dedup(docs)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose word shingles are alike at 0.8 or more: the one with the smallest id, and one row of that."""
    common.prepare(spark)
    return simhash.keep_one_similar(docs, words=SHINGLE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    common.prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A trained classifier, SimHash and a tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
