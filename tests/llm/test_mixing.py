"""Mixing: the exponent against brute force, and the realised mix against its budgets."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm.mixing import find_exponent, mixed_documents, mixing_plan, source_shares


def rows_of():
    r = random.Random(8)
    sizes = {"hot": 400, "b": 90, "c": 40, "d": 12, None: 30}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * r.randint(1, 40)), s))
            i += 1
    return rows + [(9000, None, "b"), (9001, "", "empty"), (9002, "  ", "empty")]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as weight", "2 as block").repartition(4)


def brute_exponent(totals, budget, entropy, repeats):
    p = [t / sum(totals) for t in totals]
    for k in range(200_001):
        a = k / 200_000
        z = sum(x**a for x in p)
        w = [x**a / z for x in p]
        h = -sum(x * math.log(x) for x in w) / math.log(len(w))
        if (entropy is None or h <= entropy) and (repeats is None or max(x * budget / t for x, t in zip(w, totals)) <= repeats):
            return a
    return 1.0


@pytest.mark.parametrize(("entropy", "repeats"), [(0.9, None), (None, 3.0), (0.95, 2.0), (None, 0.5), (1.0, None)])
def test_exponent(spark, entropy, repeats):
    totals = {"a": 900.0, "b": 250.0, "c": 60.0, "d": 11.0}
    shares = source_shares(spark.createDataFrame(list(totals.items()), "source string, tokens double"))
    budget = sum(totals.values())
    assert find_exponent(shares, budget, entropy, repeats) == pytest.approx(brute_exponent(list(totals.values()), budget, entropy, repeats), abs=2e-5)


def test_budgets_epochs_and_blocks(spark):
    rows = rows_of()
    tokens = {i: len((t or "").split()) for i, t, _ in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += tokens[i]
    plan = mixing_plan(table(spark, rows), target_entropy=None, max_repeats=3.0, block_tokens=1500, slot_rows=20).collect()
    spent, weight, uses = Counter(), {}, Counter()
    for r in plan:
        spent[r.source] += r.tokens
        weight[r.source] = r.weight
        uses[r.source, r.epoch, r.doc_id] += 1
    budget = sum(total.values())
    assert max(uses.values()) == 1 and "empty" not in spent and sum(weight.values()) == pytest.approx(1)
    assert max(weight[s] * budget / total[s] for s in weight) == pytest.approx(3.0, abs=1e-3)
    for s in weight:
        assert weight[s] * budget <= spent[s] + 1e-6 < weight[s] * budget + 41
        for e in range(int(weight[s] * budget / total[s])):  # whole epochs use every document with tokens
            assert sum(1 for k in uses if k[:2] == (s, e)) == sum(1 for i, _, x in rows if x == s and tokens[i])
    blocks = defaultdict(Counter)
    for r in plan:
        blocks[r.block][r.source] += r.tokens
    for b in blocks.values():
        for s in weight:
            assert abs(b[s] - weight[s] * budget / len(blocks)) <= 81
    assert all(sorted(r.place for r in plan if r.block == b) == list(range(1, sum(r.block == b for r in plan) + 1)) for b in blocks)


def test_documents_and_edge_tables(spark):
    docs = table(spark, rows_of())
    mixed = mixed_documents(docs, budget_share=None, target_entropy=None, max_repeats=1.5)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) == {i for i, t, _ in rows_of() if (t or "").split()} and max(times.values()) == 2
    assert mixing_plan(docs.limit(0)).count() == 0 and mixed_documents(docs.filter("source = 'empty'")).count() == 0
    again = docs.filter("doc_id < 5").union(docs.filter("doc_id < 5")).withColumn("source", F.lit(None).cast("string"))
    assert mixed_documents(again, target_entropy=None).count() == 10


def test_exponents_above_one_and_targets_out_of_reach(spark):
    shares = source_shares(spark.createDataFrame([("a", 400.0), ("b", 300.0), ("c", 300.0)], "source string, tokens double"))
    p = [0.4, 0.3, 0.3]

    def entropy(a):
        w = [x**a / sum(y**a for y in p) for x in p]
        return -sum(x * math.log(x) for x in w) / math.log(3)

    for target in (0.97, 0.6, 0.05):
        found = find_exponent(shares, 1000.0, target, None)
        assert found > 1 and entropy(found) == pytest.approx(target, abs=1e-5)
    even = source_shares(spark.createDataFrame([("a", 5.0), ("b", 5.0)], "source string, tokens double"))
    assert find_exponent(even, 10.0, 0.9, None) == 1.0
    docs = spark.createDataFrame([(i, "w w w", "ab"[i % 2]) for i in range(8)], "doc_id long, text string, source string")
    plan = mixing_plan(docs, target_entropy=0.9).collect()
    assert len(plan) == 8 and {r.met for r in plan} == {False} and {r.weight for r in plan} == {0.5}


def test_part_of_the_gap(spark):
    rows = rows_of()
    plan = mixing_plan(table(spark, rows), budget_share=None, target_entropy=None, keep_gap=0.5, max_repeats=None).collect()
    weight, share = ({r.source: getattr(r, c) for r in plan} for c in ("weight", "share"))
    h = lambda w: -sum(x * math.log(x) for x in w.values()) / math.log(len(w))
    assert 1 - h(weight) == pytest.approx((1 - h(share)) / 2, abs=1e-5) and {r.met for r in plan} == {True}
    assert weight["hot"] < share["hot"] and {r.doc_id for r in plan} == {i for i, t, _ in rows if (t or "").split()}


def test_copies_of_rows_are_dealt_exactly_and_names_clash(spark):
    rows = [(1, "w w", "small", 7, "x")] * 5 + [(2, "w w", "small", 7, "x"), (1, "w w", "small", 8, "x")] + [(10 + i, "w " * 20, "large", 0, None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, uses int, rows string").selectExpr("*", "1 AS _use", "2 AS p", "3 AS q", "'s' AS row", "1.5D AS print", "0 AS use").repartition(3)
    settings = {"budget_share": None, "target_entropy": 0.999, "max_repeats": None}
    plan = Counter((r.doc_id, r.source) for r in mixing_plan(docs, **settings).collect())
    mixed = mixed_documents(docs, **settings)
    assert mixed.columns == docs.columns
    found = Counter(tuple(r) for r in mixed.collect())
    assert sum(n for r, n in found.items() if r[2] == "small") == sum(n for (_, s), n in plan.items() if s == "small") > 14
    assert set(found) == {tuple(r) for r in docs.collect()}
    first, other = found[next(r for r in found if r[3] == 7 and r[0] == 1)], found[next(r for r in found if r[3] == 8)]
    assert first >= 5 * (other - 1)
