"""A corpus from raw documents to token counts: each stage reads all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendgrain.llm import language, mixing, pieces, secret_scan, setsketch
from spendgrain.llm.common import small_batches, stored, table
from spendgrain.llm.registry import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts that are null or have no letter go."""
    small_batches(spark)
    return language.recognised(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    small_batches(spark)
    return setsketch.kept_documents(docs, setsketch.near_duplicates(docs, percent=80))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by the name of the kind."""
    small_batches(spark)
    return secret_scan.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, number of pieces, and digests of ids, decoded text and spans."""
    small_batches(spark)
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("sentencepiece", encoded),
]

# Trained and hashed stages have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each result but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
