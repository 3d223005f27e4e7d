"""From raw documents to packed training sequences, one operator per stage.

Every stage takes all rows that its predecessor kept. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradelake.llm import language, mixing, packing, quality, simhash
from gradelake.llm.common import settled, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return language.keep_known_language(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; ``labels`` says which ones are trusted."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a packed sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("quality_rules", good),
    ("simhash_near_dedup", distinct),
    ("mixing_sources", mixed),
    ("best_fit_packing", packed),
]

# Cross-parsing, hashed n-grams, fingerprints and tokens are no SQL; tests/llm compares every
# stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
