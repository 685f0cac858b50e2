"""Grams against plain loops; what is in the table of bits by chance is left out, and spans are not shuffled."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from quire.operators import grams, matching

PATTERN = "\\p{L}+"


def _works(spark):
    r = random.Random(3)
    texts = ["\n".join(" ".join(r.choice(["Red", "sea", "the", "wide", "ΝΥΞ", "no"]) for _ in range(r.randrange(9))) for _ in range(r.randrange(6))) for _ in range(60)]
    rows = [*enumerate(texts), (60, None), (61, ""), (62, "\n\n")]
    return rows, spark.createDataFrame(rows, "work_id long, text string").repartition(4)


def _plain(rows, sizes):
    found = []
    for work, text in rows:
        at = 0
        for i, line in enumerate((text or "").split("\n")):
            ws = [w.lower() for w in line.split()]
            found += [(work, i + 1, at + k + 1, at + k + n, " ".join(ws[k : k + n])) for k in range(len(ws)) for n in sizes if k + n <= len(ws)]
            at += len(ws)
    return found


def test_frequent_phrases_and_spans(spark):
    rows, works = _works(spark)
    spans = _plain(rows, [2, 3, 4])
    often = {p for p, n in Counter(s[4] for s in spans).items() if n >= 5}
    phrases = grams.frequent_phrases(works, [2, 3, 4], PATTERN, 5)
    assert often and {r.phrase for r in phrases.collect()} == often
    got = matching.phrase_candidates(works, spark.createDataFrame([(p,) for p in sorted(often)], "phrase string"), PATTERN)
    assert sorted(map(tuple, got.collect())) == sorted(s for s in spans if s[4] in often)


def test_what_is_in_the_table_by_chance_is_left_out(spark, monkeypatch):
    rows, works = _works(spark)
    monkeypatch.setattr(grams, "phrase_bits", lambda phrases: grams.Bits(np.full((1, grams.BLOCK // 8), 255, np.uint8)))
    phrases = spark.createDataFrame([("red sea",), ("the wide no",)], "phrase string")
    got = matching.phrase_candidates(works, phrases, PATTERN)
    assert sorted(map(tuple, got.collect())) == sorted(s for s in _plain(rows, [2, 3]) if s[4] in ("red sea", "the wide no"))


def test_spans_are_neither_joined_nor_shuffled(spark):
    """Every run of words was shuffled to meet the phrases, and every span to meet its line."""
    _, works = _works(spark)
    works = spark.createDataFrame(works.collect(), works.schema)
    spans = matching.phrase_spans(works, spark.createDataFrame([("red sea",)], "phrase string"), PATTERN)
    for df in (spans, matching.phrase_select_longest(spans), matching.phrase_select_greedy(spans)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
