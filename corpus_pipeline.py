"""A training-data pipeline over ``documents``: quality rules, exact and near deduplication, mixing, encoding.

Defined cases, for all stages: a null text is without words, so the quality rules reject it; a null identifier is one like
any other but comes last where the smallest stays; rows that share an identifier but not a text are documents of their
own; of whole rows that stand twice, exact dedup keeps one; a null source is one source, the last; an empty table gives
an empty result; other columns are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, exact_dedup, fertility, mixing, simhash
from loomgraph.llm.common import documents, release, staged, staged_so_far


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go."""
    return fertility.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier stays."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (0.8 on five-word shingles) the document with the smallest identifier stays."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the document's identifier; one row for each time it is taken."""
    return bpe.encode(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_duplicates), ("near dedup", near_duplicates), ("mixing", mixture), ("encoding", encoded)]

#: Trie owners, fingerprints, sampling keys and BPE can't be put in SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written; then what it read and wrote on the way is deleted."""
    docs, before = documents(spark, sf_dir), staged_so_far()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, before, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
