"""Words stored as numbers, and longer runs looked for only where their parts are."""

from __future__ import annotations

import random

import pytest

from quire.operators import grams
from quire.plans import base


@pytest.fixture(scope="module")
def works(spark):
    r = random.Random(11)
    texts = ["\n".join(" ".join(r.choice(["Red", "sea", "the", "wide", "νυξ", "no"]) for _ in range(r.randrange(20))) for _ in range(r.randrange(6))) for _ in range(300)]
    return spark.createDataFrame([*enumerate(texts), (300, None), (301, ""), (302, "\n\n")], "work_id long, text string").repartition(3)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_coded_words_are_the_works(spark, works):
    """every pass over the works parted their texts into words again."""
    sizes, coded = [2, 3, 4, 5, 6], grams.coded(works, base.LETTERS)
    assert coded.count() == 3
    found = [_rows(grams.frequent_phrases(w, sizes, base.LETTERS, 5)) for w in (works, coded)]
    assert found[0] == found[1] and {len(p.split()) for (p,) in found[0]} >= {2, 3, 4}
    bits = grams.phrase_bits(spark.createDataFrame([("red sea",), ("no the wide",)], "phrase string"))
    for choose in (grams.longest_first, grams.leftmost_first):
        listed = grams.Listed([2, 3], bits, [])
        for step in (grams.judged_phrases, grams.covered_words, grams.words_apart):
            assert _rows(step(works, base.LETTERS, listed, choose)) == _rows(step(coded, base.LETTERS, listed, choose)), step


@pytest.mark.parametrize("sizes", [[2, 3, 4, 5, 6], [3, 4], [2]])
def test_runs_within_their_parts(spark, works, sizes):
    """all runs of all sizes were looked for; those of frequent phrases are found by their parts."""
    bits = grams.bits_of(grams.frequent_hashes(works, sizes, base.LETTERS, 4))
    asked = []
    for batch in grams.lines_of_words(works, base.LETTERS).toArrow().to_batches():
        part = grams.Part.read(batch)
        plain, nested = (list(f(sizes, bits)) for f in (part.held, part.nested))
        assert [(n, at.tolist(), h.tolist()) for n, at, h in plain] == [(n, at.tolist(), h.tolist()) for n, at, h in nested]
        asked += [n for n, at, _ in nested if len(at)]
    assert sizes[0] in asked


def test_phrase_queries_read_stored_words(spark):
    from quire.catalogue import QUERIES

    for name in ("phrase_scope_rule", "phrase_select_longest", "phrase_candidates", "match_sensorimotor_unigram"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "codes" in plan and "regexp_extract_all" not in plan, name
