"""Base spans against the plain patterns, and discovery of unseen identifiers."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from quire.llm.pii import KINDS, _Words, base_spans, candidates, induced, joined, luhn, occurrences, personal_data, scored, strengths

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p.lstrip("0")[:4] or 0) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(7)
    bits = ["a", "b.c", "@", "@x.y", ".", "-", "1", "12", "255", "256", "1.2.3.4", " ", "+", "+1 (555) 123-4567", "(", ")", "4111111111111111", "4111 1111 1111 1111", "é", "\n", "%", "0"]
    for _ in range(6000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert base_spans(t) == plain(t), t


def test_long_texts_take_linear_time():
    start = time.time()
    for t in ("a" * 300_000 + "@", "@a" * 150_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "+1 " * 100_000, "x@y" * 100_000):
        base_spans(t)
    assert time.time() - start < 20


def test_rows_and_discovery(spark):
    r = random.Random(2)
    rows = []
    for i in range(60):
        filler = " ".join(r.choice("lorem ipsum dolor sit amet vita nova".split()) for _ in range(20))
        if i < 40:
            rows.append((i, f"{filler} please write john{i}@mail.example.org today {filler}"))
        elif i < 50:
            rows.append((i, f"{filler} please write jane{i}(at)corp.example soon {filler}"))
        else:
            rows.append((i, f"{filler} lorem ipsum item{i}(at)shelf.example {filler}"))
    rows += [(100, None), (101, ""), (102, "é +1 (632) 555-4827, 4539578763621486"), (102, "é +1 (632) 555-4827, 4539578763621486")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as print").repartition(3)
    got = personal_data(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for g in got:
        want = plain(texts[g.doc_id] or "")
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert g.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        if 40 <= g.doc_id < 50:
            kind, a, b = g.spans.split(":")
            assert kind == "email" and texts[g.doc_id][int(a) : int(b)] == f"jane{g.doc_id}(at)corp.example" and g.n_added == 1
        else:
            assert g.spans == joined(want) and g.n_added == 0


def test_long_zeros_and_long_words(spark):
    rows = [(1, "0" * 5000 + ".1.2.3"), (2, "1." + "0" * 6000 + ".2.3"), (3, "w" * 3000 + " " + "v" * 3000 + " 1.2.3.4")]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d].base_sha256 == hashlib.sha256(joined(plain(t)).encode()).hexdigest() for d, t in rows)
    assert got[1].n_ip == got[2].n_ip == got[3].n_ip == 1


def test_new_instances_induce_new_patterns(spark):
    """Seeds give "tel:", its other instances stand before "ext", and "ext" finds what has no label: spaced,
    masked and glued values, at a line's start and end."""
    r = random.Random(5)
    number = lambda: f"{r.randint(100, 999)} {r.randint(100, 999)} {r.randint(1000, 9999)}"
    filler = lambda: " ".join(r.choice("lorem ipsum dolor sit amet vita nova".split()) for _ in range(12))
    rows, want = [], {}
    for i in range(24):
        rows.append((i, f"{filler()}\ntel:+1 (632) 555-{4000 + i} {filler()}"))
    for i in range(24, 40):
        rows.append((i, f"{filler()}\nTel: {(value := number())} ext {filler()}"))
        want[i] = value
    for i in range(40, 46):
        rows.append((i, f"{filler()} {(value := number())} ext {filler()}"))
        want[i] = value
    rows += [(50, f"{filler()} room {number()} {filler()}")]
    got = {x.doc_id: x for x in personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = dict(rows)
    for i, t in texts.items():
        added = [s for s in got[i].spans.split(",") if s and s not in joined(plain(t)).split(",")]
        assert [t[int(a) : int(b)] for _, a, b in (s.split(":") for s in added)] == ([want[i]] if i in want else []), i
    assert sum(x.n_added for x in got.values()) == len(want)


def test_scores_equal_a_plain_computation(spark):
    """The graph's rounds against loops over its edges."""
    r = random.Random(6)
    edges = {(0, r.randrange(12), f"v{r.randrange(30)}"): (r.randint(1, 4), r.randint(1, 3)) for _ in range(120)}
    seeds = {f"v{i}" for i in range(12)}
    totals = {c: r.randint(1, 40) for c in range(12)}
    graph = spark.createDataFrame([(k, c, v, n, d, v in seeds) for (k, c, v), (n, d) in edges.items()], "kind int, context long, value string, n long, docs long, seed boolean")
    accepted, known = {v: 1.0 for v in seeds}, spark.createDataFrame(list(totals.items()), "context long, total long")
    for _ in range(3):
        patterns = [c for c in range(12) if sum(1 for (_, x, v) in edges if x == c and v in accepted) >= 3 and sum(d for (_, x, v), (_, d) in edges.items() if x == c and v in accepted) >= 3]
        strong = {}
        for c in patterns:
            inside = {v: n for (_, x, v), (n, _) in edges.items() if x == c}
            strong[c] = min(sum(n * accepted.get(v, 0.0) for v, n in inside.items()) / max(totals[c], sum(inside.values())), 0.999)
        frame = spark.createDataFrame([(0, v, s) for v, s in accepted.items()], "kind int, value string, score double")
        found = induced(graph, frame, 3)
        assert sorted(x.context for x in found.collect()) == patterns
        got = strengths(graph, found, known, frame)
        assert {x.context: round(x.strength, 9) for x in got.collect()} == {c: round(s, 9) for c, s in strong.items()}
        strong = {c: s for c, s in strong.items() if s >= 0.3}
        scores = {}
        for v in {v for _, _, v in edges}:
            miss = 1.0
            for c, s in strong.items():
                miss *= 1 - s if (0, c, v) in edges else 1
            scores[v] = 1.0 if v in seeds else 1 - miss
        values = scored(graph, got.filter("strength >= 0.3"))
        assert {x.value: round(x.score, 9) for x in values.collect()} == {v: round(s, 9) for v, s in scores.items()}
        accepted = {v: s for v, s in scores.items() if s >= 0.3}


def test_occurrences_equal_a_plain_count(spark):
    texts = ["Tel: 5 (a) b|c\nd 77", "a b", None, "", "x\n\ny: z", "a"]
    seen = Counter()
    for t in texts:
        words = _Words(t or "")
        for a, b in words.spans:
            seen.update(words.beside(a, b))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {x.context: x.total for x in occurrences(docs, np.array(list(seen), np.int64)).collect()}
    assert got == dict(seen)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")
    assert personal_data(docs.limit(0)).count() == 0
    assert [tuple(r) for r in personal_data(docs).collect()] == [(1, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)]


@pytest.mark.parametrize("piece", ["0" * 43 + "a ", "0" * 43 + " ", "*" * 43 + "a ", "00 " * 14 + "a ", "0-" * 20, "x" * 30 + "@", "+" * 40, "(0" * 20 + " ", "f:" * 20 + "g ", "1." * 20 + "a"])
def test_candidates_take_linear_time(piece):
    text = piece * (1_000_000 // len(piece))
    start = time.process_time()
    candidates(text, [])
    candidates(text.replace(" ", ""), [])
    assert time.process_time() - start < 8  # two megabytes


def test_cards_and_overlaps():
    cards = lambda t: [t[a:b] for a, k, b in candidates(t, []) if k == 2]
    assert cards("a 4111 1111 1111 1111 b") == ["4111 1111 1111 1111"]
    assert cards("4111-xxxx-xxxx-1111.") == ["4111-xxxx-xxxx-1111"] and cards("0" * 16) == ["0" * 16]
    assert cards("0" * 43) == [] and cards("12 345") == [] and cards("1234 5678 9012a 11") == []
    assert cards(" ".join(["0000"] * 9)) == [" ".join(["0000"] * 7)]
    text = "4111 1111 1111 1111"
    assert candidates(text, [(0, 30), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (3, 5)]) == []  # the first of many that begin before it reaches over it
