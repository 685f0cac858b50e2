"""SimHash groups against a plain count of bits and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from quire.llm.simhash import _ordered, fingerprint, join_tiles, links, simhash_groups, tile_pairs, tiles

SCHEMA = "doc_id long, text string"


def plain(text, size=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, ids, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ä", "É", "\x1cx", "x y", "ß"]
    rows = [" ".join(r.choices(words, k=r.randint(0, 90))) for _ in range(60)]
    for t in rows[:12]:
        parts = t.split(" ")
        for _ in range(r.choice([1, 25])):
            copy = list(parts)
            copy[r.randrange(len(copy))] = "New"
            rows.append(" ".join(copy))
    return rows + [None, "", " \t\n", "One", "one", "one  TWO", "one two three", "one two three four", rows[0], rows[0]]


def test_fingerprints_by_pieces():
    for t in texts():
        assert fingerprint(t) == plain(t)
        assert fingerprint(t, piece=7) == plain(t)
    assert fingerprint("a b c d e", size=1) == plain("a b c d e", 1)


def test_groups(spark):
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts())] + [(None, "nobody else has these five words")]
    prints = [plain(t) for _, t in rows]
    want = sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, grouped(prints, [d for d, _ in rows]))), key=str)
    docs = spark.createDataFrame(rows, SCHEMA)
    for tile in (16_384, 9):
        assert sorted(map(tuple, simhash_groups(docs, tile=tile).collect()), key=str) == want
    assert sum(a[2] != a[0] for a in want) > 100


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d", 9, 8, "x")], SCHEMA + ", v long, fp long, component_id string")
    assert [tuple(x) for x in simhash_groups(docs).collect()] == [(1, f"{plain('a b c d'):016x}", 1)]
    assert simhash_groups(docs.limit(0)).collect() == []


def test_a_long_text():
    text = "lorem ipsum dolor sit amet " * 60_000 + "x" * 500_000
    assert fingerprint(text) == plain("lorem ipsum dolor sit amet " * 60_000 + "x" * 500_000)


@pytest.mark.parametrize("dense", [False, True])
def test_tiles_lose_nothing(spark, dense):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 300, np.uint64) if not dense else np.full(300, 0x0F0F, np.uint64)
    prints = list(base)
    for p in base:
        for k in r.integers(0, 6, 3):
            flips = r.choice(64 if not dense else 12, k, replace=False).astype(np.uint64)
            prints.append(p ^ np.bitwise_or.reduce(np.uint64(1) << flips, initial=np.uint64(0)))
    prints = np.unique(np.array(prints, np.uint64))
    want = grouped([int(p) for p in prints], list(range(len(prints))))
    label = np.arange(len(prints))
    held = _ordered(prints)
    found = join_tiles(held, None, label, 4)
    assert len(set(label.tolist())) == len(set(want)) and len(found) == len(prints) - len(set(want))
    table = spark.createDataFrame([(int(p) - (1 << 64) * int(p >> np.uint64(63)),) for p in prints], "fp long")
    made = tiles(table, 40, 4)
    pairs, n = tile_pairs(made, 4).collect(), made.count()
    assert len(pairs) == len(set(pairs)) <= n * (n - 1) // 2
    # a forest inside tiles and at most as many links a pair as tiles have components
    assert links(made, 4).count() <= len(prints) * (n if dense else 2)
