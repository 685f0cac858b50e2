"""Language identification: the filters against exact sets, held-out accuracy, awkward texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm.langid import Filters, count_grams, grams, identify, train_filters

WORDS = {"aa": "the of and to in is that for with was".split(), "bb": "der die und das ist nicht mit den von zu".split(), "cc": "le la les des est une pour dans que qui".split()}


def sample(n=240, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 60))), lang) for i in range(n) for lang in [r.choice("aa bb cc".split())]]


def test_counts_are_exact(spark):
    rows = sample(60)
    want = {}
    for _, t, lang in rows:
        for g in grams(t)[0]:
            want[lang, int(g)] = want.get((lang, int(g)), 0) + 1
    got = {(r.lang, r.gram % (1 << 64)): r.n for r in count_grams(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == want


def test_filters_return_all_languages_of_each_gram(spark):
    rows = sample()
    f = train_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"), min_share=0, min_count=1, contrast=1e9, slots=1 << 16)
    sets = {lang: {int(g) for _, t, x in rows if x == lang for g in grams(t)[0]} for lang in f.langs}
    every = np.array(sorted(set().union(*sets.values())), np.uint64)
    masks = f.containing(every)[0]
    wrong = 0
    for i, lang in enumerate(f.langs):
        inside = np.array([int(g) in sets[lang] for g in every])
        found = (masks & np.uint64(1 << i)) > 0
        assert found[inside].all()
        wrong += (found & ~inside).sum()
    assert wrong <= 2


def test_held_out_accuracy_and_edges(spark):
    rows = sample() + [(900, None, "aa"), (901, "123 !?", "aa"), (902, "ж", None), (903, "the und la", None), (904, "", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    test = F.col("doc_id") % 3 == 1
    f = train_filters(docs.filter(~test))
    got = {r.doc_id: r for r in identify(docs, f, test).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == lang for i, _, lang in rows[:240])
    assert got[900].lang_pred == got[901].lang_pred == got[904].lang_pred == "und" and got[902].lang_pred in f.langs and got[902].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = train_filters(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, empty, test).collect()} == {"und"} and identify(docs.limit(0), f, test).count() == 0


def test_more_than_64_languages():
    langs = [f"l{i:03}" for i in range(130)]
    table = np.zeros((3, 64), np.uint64)
    table[2] = 2  # language 129 everywhere
    assert Filters(langs, "l000", table, 2).langs[129] == "l129"
    assert int(Filters(langs, "l000", table, 2).containing(grams("some words")[0])[2][0]) == 2
