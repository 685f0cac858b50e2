"""Pseudo-likelihood: counts and scores against brute force, whatever the partitions, and order that matters."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quire.llm.hashing import hashed_words
from quire.llm.pseudo_likelihood import Window, encode, learn, numbered, pseudo_likelihoods, score, score_documents, word_counts

SCHEMA = "doc_id long, text string"
SMALL = {"vocabulary": 15, "alone": 3, "together": 5, "hidden": 6, "steps": 40}


def sample(n=120):
    r = random.Random(3)
    rows = []
    for i in range(n):
        w = r.randrange(20)
        words = []
        for _ in range(r.randint(10, 120)):
            w = (w + 1) % 20 if r.random() < 0.9 else r.randrange(20)
            words.append(f"word{w}")
        if r.random() < 0.3:
            words[0] = f"rare{i // 3}"
        rows.append((i, " ".join(words)))
    return rows


def ids_of(text, model):
    found = []
    for _, joined, _, starts, hashes in hashed_words(pa.array([text], pa.string())):
        found += numbered(hashes, np.frombuffer(joined, np.uint8)[starts].astype(np.int64), model.words).tolist()
    return found


def plain(rows, trained_on, model):
    """Scores by loops over words."""
    counts = Counter(w for _, t in trained_on for w in (t or "").lower().split())
    mass = defaultdict(int)
    for w, n in counts.items():
        mass[model.class_of[ids_of(w, model)[0]]] += n
    c, out = model.classes, []
    for d, t in rows:
        words = (t or "").lower().split()
        classes = [int(model.class_of[i]) for i in ids_of(t or "", model)]
        total = 0.0
        for k, w in enumerate(words):
            left, right = classes[k - 1] if k else c, classes[k + 1] if k + 1 < len(words) else c
            total += float(model.table[(left * c + classes[k]) * (c + 1) + right]) + math.log(max(1, counts[w])) - math.log(max(1, mass[classes[k]]))
        out.append((d, len(words), total, total / len(words) if words else None))
    return out


def close(got, want):
    for g, w in zip(sorted(map(tuple, got), key=str), sorted(want, key=str), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=2e-3) and (g[3] is None) == (w[3] is None)


def test_counts_shares_and_classes(spark):
    rows = sample() + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter(w for _, t in rows for w in (t or "").split())
    assert sorted(r.n for r in word_counts(docs).collect()) == sorted(want.values())
    model, _ = learn(docs, **SMALL)
    assert 0 < len(model.words) <= 15
    share, mass = Counter(), Counter()
    for w, n in want.items():
        mass[model.class_of[ids_of(w, model)[0]]] += n
    for w, n in want.items():
        i = ids_of(w, model)[0]
        share[model.class_of[i]] += math.exp(model.shares[i]) * (1 if i < len(model.words) else n)
    assert all(s == pytest.approx(1) for s in share.values()) and len(share) > 5
    probabilities = np.exp(model.table.reshape(model.classes + 1, model.classes, model.classes + 1)).sum(axis=1)
    assert probabilities == pytest.approx(1, abs=1e-4)


def test_scores_equal_a_plain_computation(spark):
    rows = sample(60) + [(500, None), (501, ""), (502, "one"), (502, "one"), (None, "Word1 word2"), (503, " ".join(["word3 rare1"] * 30_000))]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_tokens", "2 as row")
    model, encoded = learn(docs, **SMALL)
    close(score(encoded, model).collect(), plain(rows, rows, model))
    others = [(1, "word1 unheard words Word2"), (2, None), (2, "rare1 word1")]
    close(score_documents(spark.createDataFrame(others, SCHEMA), model).collect(), plain(others, rows, model))


def test_partitions_change_nothing(spark):
    docs = spark.createDataFrame(sample(200), SCHEMA)
    one, many = (sorted(map(tuple, pseudo_likelihoods(docs.repartition(k), **SMALL).collect())) for k in (1, 16))
    assert one == many


def test_beats_unigram_and_sees_swapped_words(spark):
    rows = sample(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    model, encoded = learn(docs, vocabulary=100, alone=25, together=5, steps=80)
    own = {r.doc_id: r for r in score(encoded, model).collect()}
    counts = Counter(w for _, t in rows for w in t.split())
    n = sum(counts.values())
    unigram = sum(c * math.log(c / n) for c in counts.values())
    assert sum(r.sum_log_probability for r in own.values()) > unigram + 0.5 * n
    r, swapped = random.Random(4), []
    for i, t in rows:
        w = t.split()
        k = r.randrange(1, len(w) - 2)
        w[k], w[k + 1] = w[k + 1], w[k]
        swapped.append((i, " ".join(w)))
    after = {x.doc_id: x.sum_log_probability for x in score_documents(spark.createDataFrame(swapped, SCHEMA), model).collect()}
    assert np.mean([after[i] < own[i].sum_log_probability for i, _ in rows]) > 0.8


def test_gradients():
    rng = np.random.default_rng(1)
    seen = rng.integers(0, 5, (5, 5, 4)).astype(np.float32)
    net = Window(4, 3)
    for p in net.parameters():
        p += rng.normal(0, 0.5, p.shape).astype(np.float32)
    loss = lambda: -float((net.log_probabilities()[1].astype(float) * seen).sum() / seen.sum())
    for p, g in zip(net.parameters(), net.gradients(seen)):
        for at in list(np.ndindex(p.shape))[::3]:
            kept = p[at]
            p[at] = kept + 1e-2
            up = loss()
            p[at] = kept - 1e-2
            down = loss()
            p[at] = kept
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_empty(spark):
    assert pseudo_likelihoods(spark.createDataFrame([], SCHEMA), **SMALL).count() == 0
    assert [tuple(r) for r in pseudo_likelihoods(spark.createDataFrame([(1, None)], SCHEMA), **SMALL).collect()] == [(1, 0, 0.0, None)]


def test_a_vocabulary_beyond_two_bytes_is_refused(spark):
    with pytest.raises(ValueError, match="two bytes"):
        encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), np.arange(65_530, dtype=np.uint64), np.ones(65_530, np.int64))
