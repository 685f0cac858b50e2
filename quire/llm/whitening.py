r"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

A vector's entries c become the integers x = floor(64 * c) + 1000000.  The covariance is that of the
distinct integer vectors (the fit list), so copies don't weigh.

1. ``integer_vectors``: rows whose vector can be read, as integers; ``fit_list``: each vector once.
2. ``moments``: n, the sums S and the scatter of x about the integers nearest to the means, one row of each
   a partition and dimension, added up by Spark.  The numbers are whole and small, so the sums are exact and
   the same under any partitioning while they stay below 2**53; the step from the nearest integers to the
   means themselves takes at most n / 4 from a diagonal entry.
3. ``pivoted_cholesky`` factors the scatter, largest remaining diagonal entry first, and stops where that is
   rounding: P A P' = L L'.  ``jacobi`` rotates pairs of columns of the triangular factor until all are
   orthogonal.  A = (P'L)(P'L)', so the columns' squared norms are A's eigenvalues and the normalised columns
   its eigenvectors, small ones as exact as large ones.  Both work on a matrix of the vectors' length, whatever
   the number of rows; the sign of a component makes its largest entry positive.
4. Each row is centred, projected and scaled in its own task.  The whitened fit list's covariance is added up
   in the same way and compared with the identity.

Edge cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped; so are
entries beyond 2**46 in size, which the arithmetic can't hold, and vectors of another length than most (of the
longest, where two lengths are equally frequent).  Components whose variance is rounding are left out, so a
table with one distinct vector has none and gives no row; ties among eigenvalues give components that span
the same space.  Rows that repeat each get their rows; null ids are kept.  n * x - S must fit in 63 bits with
its sum of squares: beyond that the call fails with OverflowError.  An empty table gives an empty result.
Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored

LARGEST = float(1 << 46)
_RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, x of the rows that stay, all of one length."""
    c = F.col("c")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST))
    read = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("c")).filter((F.size(c) > 0) & ~bad)
    lengths = read.groupBy(F.size(c).alias("d")).agg(F.count("*").alias("rows"))
    most = lengths.orderBy(F.desc("rows"), F.desc("d")).first()  # a row a length
    return read.filter(F.size(c) == (most.d if most else 0)).select("vec_id", F.transform(c, lambda v: F.floor(v * 64) + 1_000_000).alias("x"))


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct vector once."""
    return vectors.select("x").distinct()


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, d: int) -> np.ndarray:
    """Sums of the arrays ``row`` by their number ``at``: a table of d + 1 columns comes to the driver."""
    found = rows.groupBy("at").agg(F.array(*[F.sum(F.col("row")[i]) for i in range(d)]).alias("row")).orderBy("at").collect()
    return np.array([x.row for x in found])


def _added(fit: DataFrame, centre: np.ndarray, matrix: np.ndarray | None) -> np.ndarray:
    """Sum of y (first row) and of y y' over the list, where y is x - centre, times ``matrix`` if there is one."""
    d = len(centre) if matrix is None else matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d))
        for batch in batches:
            x = _matrix(batch)
            for lo in range(0, len(x), 4096):
                y = x[lo : lo + 4096] - centre
                y = y if matrix is None else y @ matrix
                total[0] += y.sum(axis=0)
                total[1:] += y.T.astype(float) @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["at", "row"])

    return _summed(fit.mapInArrow(run, "at int, row array<double>"), d)


def moments(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, S and the covariance, divisor n."""
    d = fit.select(F.size("x").alias("d")).first()
    if d is None:
        return 0, [], np.zeros((0, 0))
    sums = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d.d)]).first()
    n, totals = sums.n, list(sums[1:])
    nearest = np.array([round(s / n) for s in totals], np.int64)
    about = _added(fit, nearest, None)
    return n, totals, (about[1:] - np.outer(about[0], about[0]) / n) / n


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """F with F F' = a, of as many columns as a has rank; rows in a's order, triangular in that of the pivots."""
    rest, factor, order = a.copy(), np.zeros_like(a), np.arange(len(a))
    tiny = len(a) * np.finfo(float).eps * max(np.diag(a).max(initial=0.0), 0.0)
    for k in range(len(a)):
        p = k + int(np.argmax(np.diag(rest)[k:]))
        if rest[p, p] <= tiny:
            return factor[np.argsort(order), :k]
        swap = [p, k]
        rest[[k, p]], factor[[k, p]], order[[k, p]] = rest[swap], factor[swap], order[swap]
        rest[:, [k, p]] = rest[:, swap]
        factor[k:, k] = rest[k:, k] / np.sqrt(rest[k, k])
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor[np.argsort(order)]


def jacobi(factor: np.ndarray, sweeps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of F F', by rotating F's columns."""
    u = factor.T.copy()  # its rows are the columns
    for _ in range(sweeps):
        turned = False
        for i in range(len(u) - 1):
            for j in range(i + 1, len(u)):
                a, b, c = u[i] @ u[i], u[j] @ u[j], u[i] @ u[j]
                if abs(c) <= 4 * np.finfo(float).eps * np.sqrt(a * b):
                    continue
                turned = True
                zeta = (b - a) / (2 * c)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                u[i], u[j] = cos * (u[i] - t * u[j]), cos * (u[j] + t * u[i])
        if not turned:
            break
    values = (u * u).sum(axis=1)
    order = np.argsort(-values, kind="stable")
    units = (u[order] / np.sqrt(values[order])[:, None]).T
    if units.size:
        units *= np.sign(units[np.abs(units).argmax(axis=0), np.arange(units.shape[1])])
    return values[order], units


def whiten(rows: DataFrame, components: int = 16, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that stays and component."""
    vectors = stored(integer_vectors(rows, id_column, vector_column), "integer-vectors")
    fit = stored(fit_list(vectors), "fit-list")
    n, totals, covariance = moments(fit)
    values, units = jacobi(pivoted_cholesky(covariance))
    values, units = values[:components], units[:, :components]
    if not len(values):
        return rows.sparkSession.createDataFrame([], _RESULT)
    trace, sums = float(np.trace(covariance)), np.array(totals, np.int64)
    mean, scaled = sums / n, units / np.sqrt(values)
    second = _added(fit, mean, scaled)
    found = second[1:] / n - np.outer(second[0] / n, second[0] / n)
    error, explained, k, d = float(np.abs(found - np.eye(len(values))).max()), values / trace, len(values), len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                x = _matrix(batch)
                if int(np.abs(x).max()) * n >= 1 << 62 or d * int(np.abs(x * n - sums).max()) ** 2 >= 1 << 63:
                    raise OverflowError("n * x - S does not fit in 63 bits")
                away = x * n - sums
                each = lambda v, kind: pa.array(np.repeat(v, k), kind)
                white = ((away / n) @ scaled).ravel()
                many = batch.num_rows
                columns = [batch.column("vec_id").take(each(np.arange(many), pa.int64())), pa.array(np.tile(np.arange(1, k + 1), many), pa.int32()), pa.array(np.full(many * k, n)), each((away * away).sum(axis=1), pa.int64()), pa.array(white), pa.array(np.tile(explained, many)), pa.array(np.full(many * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, _RESULT)
