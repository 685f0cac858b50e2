"""Near-duplicate groups against brute force."""

import random
import re

import pytest

from quire.llm.components import components
from quire.llm.minhash import drop_near_copies, near_groups


def brute(rows, size):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def sample(n_groups=14, seed=6):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for g in range(n_groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 16))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((i, " ".join(copy)))
            i += 1
        chain = list(base)
        for step in range(8 if g % 3 == 0 else 0):  # links in a chain, the ends far apart
            chain[(step * 7) % len(chain)] = f"new{step}"
            chain[(step * 11 + 3) % len(chain)] = f"newer{step}"
            rows.append((i, " ".join(chain)))
            i += 1
    r.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (905, "one two"), (906, "É x y"), (907, "é x y"), (None, "nobody's text here at all"), (908, "\x1ca b"), (908, "\x1ca b")]


@pytest.mark.parametrize("size", [2, 5])
def test_groups(spark, size):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 as v", "'k' as keys").repartition(5)
    assert sorted(map(tuple, near_groups(docs, size, parts=24).collect()), key=str) == brute(rows, size)


def test_large_buckets_of_dissimilar_texts(spark):
    """Many texts share a long passage, so that they meet in buckets; only some of them are near copies, and
    not of the bucket's centre.  Buckets of more than two go through the exact join."""
    r = random.Random(3)
    passage = [f"common{i}" for i in range(60)]
    rows = []
    for g in range(40):
        own = [f"g{g}x{i}" for i in range(r.randint(18, 60))]
        for c in range(r.choice([1, 1, 2, 3])):
            copy = list(own)
            copy[r.randrange(len(copy))] = f"edit{g}y{c}"
            rows.append((len(rows), " ".join(passage + copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for small in (2, 32):
        assert sorted(map(tuple, near_groups(docs, 2, parts=24, small=small).collect()), key=str) == brute(rows, 2)


def test_one_row_of_each_group_stays(spark):
    w = " ".join(f"w{i}" for i in range(40))
    rows = [(0, w), (1, "another text " * 9), (1, w + " end"), (None, w + " tail"), (5, None), (5, None), (6, ""), (1, w + " end")]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(0, w), (1, "another text " * 9), (5, None), (6, "")], key=str)


def test_a_very_long_text(spark):
    r = random.Random(8)
    words = [f"t{r.randint(0, 10**6)}" for _ in range(60_000)]
    other = list(words)
    for i in range(0, 60_000, 100):
        other[i] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:30_000]))], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in near_groups(docs, 2).collect()} == {1: 1, 2: 1, 3: 3}


def test_empty_and_no_links(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z")], "doc_id long, text string")
    assert near_groups(docs.limit(0)).count() == 0
    assert [tuple(r) for r in near_groups(docs, 2).orderBy("doc_id").collect()] == [(1, 5, 1, True), (2, 5, 2, True)]
    assert drop_near_copies(docs.selectExpr("*", "'x' as source")).columns == ["doc_id", "text", "source"]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (300, 299), (299, 300)]
    got = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100, 300: 299, 299: 299}
