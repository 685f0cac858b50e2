"""The divergence audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quire.llm.divergence import _filled, chunk_counts, chunk_table, divergence_audit, kept_counts, numbered_groups

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs, top):
    docs, count, groups = defaultdict(set), Counter(), set()
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            docs[lang, w].add(i)
            count[lang, source, w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), d in docs.items() if x == lang and len(d) >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        p = {}
        for s in sources:
            n = sum(count[lang, s, w] for w in kept)
            p[s] = {w: 1 + 10**9 * (count[lang, s, w] + 5) // (n + 5 * len(kept)) for w in kept}
        whole = Counter({w: sum(count[lang, s, w] for s in sources) for w in kept})
        q = {w: 1 + 10**9 * (whole[w] + 5) // (sum(whole.values()) + 5 * len(kept)) for w in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if count[lang, s, w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def sample():
    r = random.Random(8)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)] + ["É", "é", "naïve", "日本", "ß"]
    weights = [1 / (i + 1) for i in range(len(words))]
    shapes = ["{}", "{},", "{}.", "({})", "{}-{}", "{}'s", "{}7{}", "\x1c{}", "{} x"]
    rows = []
    for i in range(260):
        chunks = []
        for _ in range(r.randint(0, 40)):
            w = r.choices(words, weights)[0]
            w = w if r.random() < 0.7 else w.capitalize() if r.random() < 0.5 else w.upper()
            chunks.append(r.choice(shapes).replace("{}", w))
        rows.append((i, r.choice([" ", "\n", "\t ", "\x0b"]).join(chunks), r.choice(["en", "en", "en", "de", None]), r.choice(["a", "a", "a", "b", "Ä", None])))
    return rows + [(1000, None, "fr", "only"), (1001, "", "fr", "other"), (1002, "12 34 __", "fr", None), (None, "words and words", "es", "one"), (5, rows[5][1], "en", "a"), (5, rows[5][1], "en", "a")]


@pytest.mark.parametrize("min_docs, bits", [(30, 1 << 23), (4, 32)])
def test_audit(spark, min_docs, bits):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = sorted(map(tuple, divergence_audit(docs, min_docs=min_docs, top=6, bits=bits).collect()))
    assert found == plain(rows, min_docs, 6)
    assert {x[2] for x in found} == {"pair", "term"}


def test_documents_between_the_bounds(spark):
    # "ab" stands in 4 documents as two chunks each, and in the other 5 as one of three chunks: 9 documents, 4 at least, 13 at most
    rows = [(i, "ab ab, x", "en", "s") for i in range(4)] + [(9 + i, t + " x", "en", "s") for i, t in enumerate(["AB", "(ab)", "ab-", "AB", "(ab)"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    filled = _filled(docs.repartition(3))
    groups = numbered_groups(filled)
    terms = lambda least: {x.term for x in kept_counts(filled, groups, least).collect()}
    assert terms(9) == {"ab", "x"}
    assert terms(10) == set()
    table = chunk_table(chunk_counts(filled.join(groups, ["lang", "source"]))).collect()
    chunk = {x.chunk: (x.terms, x.ks, x.docs, x.ns) for x in table}
    assert len(table) == len(chunk) and chunk["ab"] == (["ab"], [1], [4], [4]) and chunk["x"] == (["x"], [1], [9], [9])


def test_clashing_columns_long_texts_and_empty_table(spark):
    long = "verylong" * 200_000 + " " + "a,b;" * 100_000
    rows = [(i, long if i == 3 else "a b", "en", "s", 1, "t") for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA + ", n long, term string").withColumn("id", docs_id()).withColumn("chunk", docs_id())
    assert sorted(map(tuple, divergence_audit(docs, min_docs=2).collect())) == plain([x[:4] for x in rows], 2, 50) == []
    other = spark.createDataFrame([(9, "a b b", "en", "u")], SCHEMA)
    assert sorted(map(tuple, divergence_audit(docs.select("doc_id", "text", "lang", "source").union(other), min_docs=2).collect())) == plain([x[:4] for x in rows] + [(9, "a b b", "en", "u")], 2, 50)
    assert divergence_audit(docs.limit(0)).collect() == []


def docs_id():
    from pyspark.sql import functions as F

    return F.lit("clash")
