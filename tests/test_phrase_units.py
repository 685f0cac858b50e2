"""Phrases are chosen, and words parted from them, inside the works' rows: equal to the operators on tokens and spans, and no token is
shuffled to meet a span."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import grams, matching, review, structure
from quire.plans import base

PHRASES = ["red sea", "the wide", "wide sea the", "no no no no", "the red sea no"]


@pytest.fixture(scope="module")
def parts(spark):
    r = random.Random(5)
    texts = ["\n".join(" ".join(r.choice(["Red", "sea", "the", "wide", "νυξ", "no"]) for _ in range(r.randrange(30))) for _ in range(r.randrange(6))) for _ in range(80)]
    works = spark.createDataFrame([*enumerate(texts), (80, None), (81, ""), (82, "\n\n")], "work_id long, text string")
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    listed = grams.Listed([2, 3, 4], grams.phrase_bits(phrases), [])
    tokens = structure.work_tokens(works, base.LETTERS).select("work_id", "pos", "form")
    return works, phrases, listed, tokens, matching.phrase_spans(works, phrases, base.LETTERS)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _lexicon(spark, extra="long"):
    return spark.createDataFrame([("red", 1), ("no", 2)], f"form string, value {extra}")


def test_chosen_phrases_are_those_of_the_spans(parts):
    works, _, listed, _, spans = parts
    assert _rows(grams.judged_phrases(works, base.LETTERS, listed)) == _rows(matching.phrase_select_longest(spans))
    greedy = grams.judged_phrases(works, base.LETTERS, listed, grams.leftmost_first).filter("selected").select("work_id", "line_no", "first", "last", "phrase")
    assert _rows(greedy) == _rows(matching.phrase_select_greedy(spans))


def test_what_is_in_the_table_by_chance_is_not_chosen(parts):
    works, _, listed, _, spans = parts
    full = grams.Bits(np.full((1, grams.BLOCK // 8), 255, np.uint8))
    found = {r.phrase for r in grams.judged_phrases(works, base.LETTERS, grams.Listed([2, 3, 4], full, [])).select("phrase").distinct().collect()}
    got = grams.judged_phrases(works, base.LETTERS, grams.Listed([2, 3, 4], full, sorted(found - set(PHRASES))))
    assert _rows(got) == _rows(matching.phrase_select_longest(spans))


def test_policy_scope_and_coverage_are_those_of_tokens(spark, parts):
    works, phrases, listed, tokens, spans = parts
    chosen, lexicon = matching.phrase_select_longest(spans).cache(), _lexicon(spark)
    apart, covered, judged = (f(works, base.LETTERS, listed) for f in (grams.words_apart, grams.covered_words, grams.judged_phrases))
    assert _rows(review.phrase_preferred(apart, covered, judged, lexicon)) == _rows(review.phrase_policy(matching.match_exact(tokens, lexicon), chosen, "phrase_preferred"))
    content = lexicon.select("form", F.lit(True).alias("c"))
    want = review.phrase_scope(tokens.join(content, "form", "left").fillna(False, ["c"]), chosen, "c").select("work_id", "pos", "eligible")
    scope = grams.scope_of(review.words_in_scope(phrases, content, "c"))
    assert _rows(review.scope_of_phrases(apart, grams.covered_words(works, base.LETTERS, listed, scope=scope), content, "c")) == _rows(want)
    facts = [F.col("form").isin("red", "no").alias("matched"), F.col("form").isin("the", "sea").alias("is_stopword"), (F.col("form") == "no").alias("excluded")]
    want = review.stopword_coverage(review.in_spans(tokens, chosen).select("work_id", "form", *facts, F.col("phrase").isNotNull().alias("in_phrase")))
    got = review.stopword_coverage_of_forms(apart.select("work_id", *facts, F.size("free").alias("free"), F.col("covered").alias("in_phrase")))
    assert _rows(got.select(*want.columns)) == _rows(want)


def test_a_scope_leaves_out_what_is_in_its_table_by_chance(spark, monkeypatch):
    monkeypatch.setattr(grams, "bits_of", lambda hashes: grams.Bits(np.full((1, grams.BLOCK // 8), 255, np.uint8)))
    scope = grams.scope_of(spark.createDataFrame([("red", True), ("sea", False)], "word string, inside boolean"))
    assert scope.others == ["sea"]


def test_multiword_hits_are_those_of_tokens(spark, parts):
    works, _, listed, tokens, spans = parts
    lexicon = _lexicon(spark).select("form")
    lemmas = tokens.withColumn("lemma", F.regexp_replace("form", "^sea$", "red"))
    want = matching.match_multiword(lemmas, matching.phrase_select_greedy(spans), lexicon)
    hits = matching.cascade_hits(lemmas.select("form", "lemma").distinct(), lexicon).select("form", "term", "method")
    words, judged = (f(works, base.LETTERS, listed, grams.leftmost_first) for f in (grams.words_apart, grams.judged_phrases))
    assert _rows(matching.multiword_hits(words, judged, hits)) == _rows(want)


def test_the_queries_shuffle_no_places(spark):
    """Tokens were shuffled by their place to meet the spans."""
    from quire.catalogue import QUERIES

    for name in ("phrase_policy", "phrase_scope_rule", "stopword_coverage", "match_sensorimotor_unigram"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in line and "pos#" in line for line in plan.splitlines()), name
