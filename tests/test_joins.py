"""Joins that avoid pairs, against all pairs; phrases of any length; ranks over ranges."""

import random

import pytest

from quire.operators import corpus, lookup, matching


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("least", [0.72, 0.5])
def test_near_forms_are_all_pairs(spark, least):
    r = random.Random(9)
    words = {"".join(r.choices("abé", k=r.randint(1, 9))) for _ in range(120)}
    for w in list(words)[:60]:
        w = list(w + "longer"[: r.randint(0, 6)])
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice(["", "a", "xy"])
        words.add("".join(w))
    words |= {"", "a", "ab", "pneumonia", "neumonia", "knight", "night", "xpneumonia"}
    words = sorted(words)
    asked, listed = words[::2] + ["neumonia", "night", "knight"], words[1::2] + ["pneumonia", "knight"]
    want = {(t, f): round(1 - d / max(len(t), len(f)), 9) for t in set(asked) for f in set(listed) if t and f and t != f and (d := edits(t, f)) <= (1 - least) * max(len(t), len(f)) + 1e-9}
    got = lookup.near_forms(spark.createDataFrame([(t,) for t in set(asked)], "term string"), spark.createDataFrame([(f,) for f in set(listed)], "form string"), least).collect()
    assert len(got) == len(want) and {(x.term, x.form): round(x.similarity, 9) for x in got} == want
    assert ("neumonia", "pneumonia") in want and any(t[0] != f[0] for t, f in want)


def test_phrases_of_any_length_and_two_choices(spark):
    text = "so the old sea and the old man\nof the sea and the old sea\n\nThe Old Man of the Sea"
    works = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "the old man")], "work_id long, text string")
    listed = ["the old", "the old man", "old man of the sea", "sea and the old sea", "the sea and", "and the", "man of"]
    phrases = spark.createDataFrame([(p,) for p in listed], "phrase string")
    assert matching.phrase_sizes(phrases) == [2, 3, 5]
    spans = matching.phrase_candidates(works, phrases, "\\p{L}+")
    want, pos = set(), {1: 1, 4: 1}
    for work, body in ((1, text), (4, "the old man")):
        for line_no, line in enumerate(body.split("\n"), 1):
            words = line.lower().split()
            for i in range(len(words)):
                want |= {(work, line_no, pos[work] + i, pos[work] + i + n - 1, p) for n in (2, 3, 5) if i + n <= len(words) and (p := " ".join(words[i : i + n])) in listed}
            pos[work] += len(words)
    assert {tuple(x) for x in spans.collect()} == want
    greedy = {(x.work_id, x.first): (x.last, x.phrase) for x in matching.phrase_select_greedy(spans).collect()}
    taken = {}
    for work, line_no in {w[:2] for w in want}:
        end = 0
        for _, _, first, last, phrase in sorted((w for w in want if w[:2] == (work, line_no)), key=lambda w: (w[2], -w[3])):
            if first > end:
                taken[work, first], end = (last, phrase), last
    assert greedy == taken
    longest = {(x.first, x.phrase) for x in matching.phrase_select_longest(spans).filter("selected and work_id = 1").collect()}
    assert (11, "sea and the old sea") in longest and (17, "old man of the sea") in longest  # longer ones that begin later win here
    assert greedy[1, 16] == (18, "the old man") and (17, "old man of the sea") not in {(f, p) for (w, f), (_, p) in greedy.items()}
    assert matching.phrase_candidates(works, phrases.limit(0), "\\p{L}+").collect() == []


def test_words_and_phrases_of_one_table(spark):
    tokens = spark.createDataFrame([(1, i + 1, w, l) for i, (w, l) in enumerate([("old", "old"), ("man", "man"), ("man", "man"), ("seas", "sea"), ("man's", "man's"), ("x", "x")])], "work_id long, pos int, form string, lemma string")
    chosen = spark.createDataFrame([(1, 1, 1, 2, "old man")], "work_id long, line_no int, first int, last int, phrase string")
    words = spark.createDataFrame([("man",), ("old",), ("sea",)], "form string")
    got = sorted(map(tuple, matching.match_multiword(tokens, chosen, words).collect()))
    assert got == [(1, 1, 2, "old man", "phrase"), (1, 3, 3, "man", "exact"), (1, 4, 4, "sea", "lemma"), (1, 5, 5, "man", "possessive")]


def test_ranks_over_ranges(spark):
    r = random.Random(2)
    values = [r.choice([0.5, 0.25, -0.0, 0.0, *[r.random() for _ in range(3)]]) for _ in range(400)]
    rows = list(enumerate(values)) + [(900, None), (901, 1e-12), (902, -1e-12)]
    got = {x.id: x for x in corpus.characteristicity(spark.createDataFrame(rows, "id long, distance double").repartition(5)).collect()}
    known = [round(v, 9) + 0.0 for _, v in rows if v is not None]
    for i, v in rows:
        if v is None:
            assert got[i].distinctive is None and got[i].characteristic is None
            continue
        d = round(v, 9) + 0.0
        p = (sum(x < d for x in known) + known.count(d) / 2) / len(known)
        assert (got[i].distinctive, got[i].characteristic) == (pytest.approx(p), pytest.approx(1 - p))
    assert len(got) == len(rows)
    assert corpus.characteristicity(spark.createDataFrame([], "id long, distance double")).collect() == []


def test_a_fingerprint_holds_every_byte_and_no_order(spark):
    rows = [(i, "ab"[i % 2], f"text {i} of many\r\nlines {i * i}") for i in range(500)] + [(900, None, ""), (901, None, None)]
    prints = lambda rows, parts, keys: {tuple(r[k] for k in keys): r.fingerprint for r in corpus.fingerprint(corpus.corpus_manifest(spark.createDataFrame(rows, "work_id long, poet string, text string").repartition(parts)), keys).collect()}
    whole = prints(rows, 1, [])
    assert whole == prints(rows[::-1], 16, []) == prints([(i, p, t and t.replace("\r\n", "\n")) for i, p, t in rows], 3, [])
    other = [(i, p, t + "." if i == 77 else t) for i, p, t in rows]
    assert prints(other, 4, []) != whole
    before, after = prints(rows, 2, ["poet"]), prints(other, 5, ["poet"])
    assert set(before) == {("a",), ("b",), (None,)} and {k for k in before if before[k] != after[k]} == {("b",)}
    assert prints(rows + [rows[3]], 2, []) != whole and prints(rows[:-1], 2, []) != whole
    codes = {r.work_id: r.codes for r in corpus.corpus_manifest(spark.createDataFrame(rows[:1] + rows[-2:-1], "work_id long, poet string, text string")).collect()}
    assert codes == {0: ["short"], 900: ["empty"]}
    issues = corpus.corpus_issues(corpus.corpus_manifest(spark.createDataFrame([(1, "a", "x\r\ny"), (2, "a", "x\ny"), (3, "a", "")], "work_id long, poet string, text string")))
    assert sorted((r.work_id, r.level, r.code) for r in issues.collect()) == [(1, "warning", "duplicate_text"), (1, "warning", "short"), (2, "warning", "duplicate_text"), (2, "warning", "short"), (3, "error", "empty")]


def test_cascade_with_spellings_held_apart(spark):
    tokens = [("polish", "polish", "polish"), ("polish", "polish", "Polish"), ("polish", "polish", "POLISH"), ("polish's", "polish's", "Polish's"), ("polish's", "polish's", "POLISH's"), ("stones", "stone", "stones"), ("marches", "march", "Marches"), ("zzz", "zzz", "zzz"), ("may", "may", "May"), ("seas'", "seas'", "seas'")]
    rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(tokens)], "work_id int, pos int, form string, lemma string, surface string")
    lexicon = spark.createDataFrame([("stone",), ("polish",), ("seas",)], "form string")
    apart = spark.createDataFrame([("polish", "polish"), ("polish", "Polish"), ("march", "March"), ("march", "MARCH"), ("may", "May"), ("may", "may")], "form string, term string")
    got = {r.surface: (r.term, r.method) for r in matching.match_cascade(rows, lexicon, apart).collect()}
    assert got == {
        "polish": ("polish", "exact"), "Polish": ("Polish", "exact"), "POLISH": (None, "collision"), "Polish's": ("Polish", "possessive"), "POLISH's": (None, "collision"),
        "stones": ("stone", "lemma"), "Marches": (None, "collision"), "zzz": (None, "unmatched"), "May": ("May", "exact"), "seas'": ("seas", "possessive"),
    }
