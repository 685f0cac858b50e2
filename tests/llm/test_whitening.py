"""Whitening against numpy's eigenvectors and plain integers."""

import math

import numpy as np
import pytest

from quire.llm.whitening import fit_list, integer_vectors, jacobi, moments, pivoted_cholesky, whiten

SCHEMA = "vec_id long, embedding array<float>"


def vectors(n=300, d=24, seed=2):
    r = np.random.default_rng(seed)
    rows = (r.normal(size=(n, d)) @ (r.normal(size=(d, d)) * np.geomspace(3, 0.05, d)) + r.normal(size=d)).astype(np.float32)
    return [(i, row.tolist()) for i, row in enumerate(rows)]


def plain(rows, k=16):
    """By vector: deviation, and the whitened entries up to sign; n, shares of the trace."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], float) / n
    values, units = np.linalg.eigh(centred.T @ centred / n)
    values, units = values[::-1][:k], units[:, ::-1][:, :k]
    away = {i: [n * c - s for c, s in zip(v, sums)] for i, v in x.items()}
    return n, {i: sum(c * c for c in v) for i, v in away.items()}, {i: np.array(v, float) / n @ units / np.sqrt(values) for i, v in away.items()}, values / np.trace(centred.T @ centred / n)


def test_whiten(spark):
    rows = vectors()
    rows += [(1000 + i, rows[0][1]) for i in range(80)]
    odd = [(2000, None), (2001, []), (2002, [None] * 24), (2003, [float("nan")] + [0.0] * 23), (2004, [float("inf")] * 24), (2005, [1.0] * 23)]
    want_n, deviation, white, shares = plain(rows)
    found = whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(5)).collect()
    assert len(found) == 16 * len(rows) and {x.n for x in found} == {want_n} == {300}
    signs = {c: np.sign(white[7][c - 1]) * np.sign(next(x.whitened for x in found if x.vec_id == 7 and x.component == c)) for c in range(1, 17)}
    for x in found:
        assert x.deviation == deviation[x.vec_id]
        assert math.isclose(x.whitened * signs[x.component], white[x.vec_id][x.component - 1], rel_tol=1e-9, abs_tol=1e-10)
        assert math.isclose(x.explained, shares[x.component - 1], rel_tol=1e-10)
        assert x.identity_error < 1e-9


def test_same_under_any_partitioning(spark):
    rows = spark.createDataFrame(vectors(), SCHEMA)
    n, sums, one = moments(fit_list(integer_vectors(rows.coalesce(1))))
    again = moments(fit_list(integer_vectors(rows.repartition(16))))
    assert (n, sums) == again[:2] and (one == again[2]).all()


def test_fewer_components_than_dimensions(spark):
    rows = [(i, [float(a), float(2 * a), 5.0]) for i, a in enumerate([1, 1, 2, 4, 9])] + [(None, [3.0, 6.0, 5.0])]
    found = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 6 and {x.component for x in found} == {1} and {x.n for x in found} == {5}
    assert all(abs(x.explained - 1) < 1e-12 for x in found)
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []


def test_ties_clashing_names_and_overflow(spark):
    rows = [(i, [a, b], "z") for i, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)])]
    found = whiten(spark.createDataFrame(rows, SCHEMA + ", x string").selectExpr("*", "1 AS c", "2 AS n")).collect()
    norm = {i: sum(x.whitened**2 for x in found if x.vec_id == i) for i in range(4)}
    assert all(abs(v - 2) < 1e-12 for v in norm.values()) and all(abs(x.explained - 0.5) < 1e-12 for x in found)
    huge = spark.createDataFrame([(1, [float(1 << 40)]), (2, [0.0]), (3, [1.0])], SCHEMA)
    with pytest.raises(Exception, match="63 bits"):
        whiten(huge).collect()
    assert {x.vec_id for x in whiten(spark.createDataFrame([(1, [3e30]), (2, [0.0]), (3, [1.0])], SCHEMA)).collect()} == {2, 3}


def test_factor_and_rotations():
    r = np.random.default_rng(4)
    f = r.normal(size=(40, 12)) * np.geomspace(1e4, 1e-4, 12)
    a = f @ f.T
    factor = pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a, rtol=0, atol=1e-12 * a.max())
    values, units = jacobi(f)
    singular = np.linalg.svd(f, compute_uv=False)
    assert np.allclose(np.sqrt(values), singular, rtol=1e-12)
    assert np.abs(units.T @ units - np.eye(12)).max() < 1e-12
