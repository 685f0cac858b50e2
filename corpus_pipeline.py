"""A training-data pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet in the
shared folder and read again as the next stage's ``docs``.  All but the last return the columns of
documents; the last returns one row for each use of a document with its token ids' description.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm._shared import stored, table
from quire.llm.bpe import bpe_roundtrip
from quire.llm.exact_dedup import drop_copies
from quire.llm.minhash import drop_near_copies
from quire.llm.mixing import mixed_documents
from quire.llm.quality_rules import clean_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate go; boilerplate lines go."""
    return clean_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_copies(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in tempered weights: every document at least once, none more than half as often again
    on its source's average as in the least repeated source."""
    return mixed_documents(docs, budget_share=None, target_entropy=None, max_repeats=1.5)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, described and decoded again."""
    return bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("byte-level BPE", encode),
]

#: Hash permutations, MinHash groups and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
