"""Quality rules against brute force."""

import random
import re
from collections import Counter, defaultdict

from quire.llm.quality_rules import clean_documents, quality_report


def normal(line):
    return re.sub("[0-9]+", "0", re.sub("[\x20\x09-\x0d]+", " ", line).strip(" ").lower())


def brute(rows, min_docs, share, loss):
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t or "")
    pages, holders = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        pages[s].add(t or "")
        for line in (t or "").split("\n"):
            if words(line):
                holders[s, normal(line)].add(t or "")
    flagged = {k for k, v in holders.items() if len(v) >= min_docs and len(v) > share * len(pages[k[0]])}
    out = []
    for i, t, s in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        many = Counter(grams)
        covered = {j + k for j, g in enumerate(grams) if many[g] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        lost = sum(len(words(x)) for x in lines if (s, normal(x)) in flagged)
        out.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, not failed and lost <= loss * len(w), lost))
    return sorted(out, key=str), flagged


def sample():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh#é") for _ in range(r.randint(1, 6)))
    rows = []
    for i in range(80):
        lines = [" ".join(word() for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 8))]
        if r.random() < 0.5:
            lines.insert(r.randint(0, len(lines)), f"Page {i}: all  rights\treserved now and for all of the time to come")
        if r.random() < 0.2:
            lines += lines[:2]
        rows.append((i, "\n".join(lines), r.choice(["a", "a", "b", None])))
    rows += [(200, None, "a"), (201, "", "a"), (202, " \t\n ", None), (203, "one two three one two three one two three " * 9, "b"), (204, "a a a a", "b"), (205, "\x1c x y", "b")]
    rows += [(300 + i, "copied page with its own lines\n" + "many words stay here " * 3, "a") for i in range(40)]
    return rows + [rows[3], rows[3], (None, rows[4][1], rows[4][2])]


def test_report(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "2 as print").repartition(4)
    want, flagged = brute(rows, 10, 0.1, 0.2)
    got = quality_report(docs, min_docs=10, max_share=0.1, max_loss=0.2)
    assert flagged and sorted(map(tuple, got.collect()), key=str) == want
    assert quality_report(docs.limit(0)).count() == 0


def test_cleaning_removes_lines_and_documents(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as cut", "length(text) as n_chars")
    want, flagged = brute(rows, 10, 0.1, 0.2)
    kept = Counter(str(w[0]) for w in want if w[7])
    got = clean_documents(docs, min_docs=10, max_share=0.1, max_loss=0.2)
    assert got.columns == docs.columns
    seen = got.collect()
    assert Counter(str(x.doc_id) for x in seen) == kept
    for x in seen:
        assert not any((x.source, normal(line)) in flagged for line in x.text.split("\n")) and x.n_chars == len(x.text)
