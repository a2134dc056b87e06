"""From raw documents to packed training sequences: five stages, each of which reads what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import mixing, naming, nearby, packing, rules
from tickloom.llm.common import keep
from tickloom.llm.queries import word_bpe


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the quality rules reject go."""
    return rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of equal texts the one with the largest doc_id stays."""
    return naming.without_copies(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: of documents linked by similar sets of five-word shingles the one with the smallest doc_id stays."""
    return nearby.one_of_each(docs, words_each=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the ids of all remaining texts in sequences of at most 2048; a document taken twice is there twice."""
    return packing.pack(docs, word_bpe)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good),
    ("exact dedup", distinct),
    ("near dedup", different),
    ("mixing", mixed),
    ("packing", packed),
]

#: Ids of a byte-pair vocabulary can't be made in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = keep(docs)
    return docs
