"""Exact deduplication against brute force, with and without colliding keys."""

import hashlib
import random

import numpy as np
import pytest

from quire.llm.exact_dedup import drop_copies, exact_groups, fingerprints, grow_directory


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "A"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 5000), (8, "x" * 5000), (None, "a"), (None, "only null id"), (9, "tie"), (9, "tie"), (10, " a")]


@pytest.mark.parametrize("key_bits", [64, 5, 1])
def test_groups(spark, key_bits):
    r = random.Random(3)
    rows = ROWS + [(100 + i, f"text {r.randint(0, 60)}") for i in range(150)] + [(1000 + i, "Hot") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", docs_key()).repartition(5)
    assert sorted(map(tuple, exact_groups(docs, capacity=8, key_bits=key_bits).collect()), key=str) == brute(rows)


def docs_key():
    from pyspark.sql import functions as F

    return F.lit("clashing name")


def test_empty_and_kept_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'s' as source")
    assert exact_groups(docs.limit(0)).count() == 0
    kept = drop_copies(spark, docs)
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 4, 5, 6, 8, None, 9, 10], key=str)


def test_directory_doubles_until_buckets_fit(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string")
    prints = fingerprints(docs)
    directory = grow_directory(prints, 40)
    depth = len(directory).bit_length() - 1
    keys = np.array([r.key for r in prints.collect()], np.int64).astype(np.uint64)
    filled = np.bincount(directory[(keys >> np.uint64(64 - depth)).astype(int)])
    assert len(directory) == 1 << depth and filled.max() <= 40 and filled.sum() == 500
    for bucket in range(directory.max() + 1):  # a bucket's entries are one aligned run of a power of two
        at = np.flatnonzero(directory == bucket)
        assert len(at) & (len(at) - 1) == 0 and at[0] % len(at) == 0 and (np.diff(at) == 1).all()
