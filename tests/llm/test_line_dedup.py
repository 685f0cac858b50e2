"""Line deduplication against brute force."""

import random

from quire.llm.line_dedup import repeated_lines, without_repeated_lines


def lines_of(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [(i, frozenset(x.split())) for i, x in enumerate(low.split("\n")) if x.split()]


def brute(rows, percent):
    lines = sorted(((d, i), s) for d, t in rows for i, s in lines_of(t))
    return {p: any(q < p and 100 * len(s & o) >= percent * len(s | o) for q, o in lines) for p, s in lines}


def sample():
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(1, 25))] for _ in range(40)]
    rows = []
    for d in range(90):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(bases))
            for _ in range(r.randint(0, 2)):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            lines.append(" ".join(line) if r.random() < 0.9 else "")
        rows.append((d, "\n".join(lines)))
    r.shuffle(rows)
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "W1 w2\nw2 w1"), (204, "a b c d e\na b c d\na b c\n" + "z " * 3000)]


def test_lines_and_texts(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as n_links", "'q' as v").repartition(5)
    want = brute(rows, 80)
    sets = {s for _, t in rows for _, s in lines_of(t)}
    links = sum(1 for a in sets for b in sets if a != b and 100 * len(a & b) >= 80 * len(a | b))
    # words of few sets only, of many sets only in one block and in several, and both
    for settings in ({}, {"common": 0}, {"common": 0, "block": 4}, {"common": 6, "block": 5, "slots": 4096}):
        lines = repeated_lines(docs, **settings).collect()
        assert {(r.doc_id, r.line_no): r.removed for r in lines} == want, settings
        assert sum({r.v: r.degree for r in lines}.values()) == links, settings
    texts = dict(rows)
    for r in without_repeated_lines(docs).collect():
        cut = [i for i, _ in lines_of(texts[r.doc_id]) if want[r.doc_id, i]]
        t = texts[r.doc_id]
        assert r.text == (t if not cut else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut))
        assert (r.n_lines, r.n_removed, r.v) == (len(lines_of(t)), len(cut), "q")


def test_links_of_each_document(spark):
    rows = sample()
    sets = {s for _, t in rows for _, s in lines_of(t)}
    near = {a: sum(1 for b in sets if a != b and 100 * len(a & b) >= 80 * len(a | b)) for a in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in without_repeated_lines(docs, common=5, block=6).collect()}
    assert got == {d: sum(near[s] for _, s in lines_of(t)) for d, t in rows}


def test_equal_and_null_ids_keep_their_own_lines(spark):
    for i in (None, 7):
        docs = spark.createDataFrame([(i, "a b c\nx y z"), (i, "p q r\na b c")], "doc_id long, text string")
        got = without_repeated_lines(docs).collect()
        lines = [x for r in got for x in r.text.split("\n")]
        assert sorted(lines) == ["a b c", "p q r", "x y z"] and [r.n_lines for r in got] == [2, 2] and sum(r.n_removed for r in got) == 1


def test_a_very_long_text(spark):
    r = random.Random(4)
    lines = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 9)) for _ in range(8)) for _ in range(80_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "word " * 200_000)], "doc_id long, text string")
    got = {x.doc_id: x for x in without_repeated_lines(docs, common=50).collect()}
    assert got[1].n_lines == 80_000 and got[2].n_lines == 1
    assert got[1].n_removed >= 80_000 - len({frozenset(x.split()) for x in lines})


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b\nc"), (2, "c")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.removed for r in repeated_lines(docs).collect()}
    assert got == {(None, 0): False, (None, 1): False, (1, 0): True, (2, 0): True}
    assert without_repeated_lines(docs.limit(0)).count() == 0
