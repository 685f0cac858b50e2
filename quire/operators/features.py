"""Archetypes and the feature map."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = {"low": 0.2, "moderate": 0.5, "high": 0.8}


def level(value):
    return F.when(value.isNull(), None).when(value <= 0.4, "low").when(value >= 0.6, "high").otherwise("moderate")


def archetype_levels(means: DataFrame) -> DataFrame:
    """Level of each dimension and the archetype's name, levels joined."""
    named = means.select("work_id", *[level(F.col(d)).alias(f"{d}_level") for d in ("valence", "arousal", "dominance")])
    return named.withColumn("archetype", F.concat_ws("-", "valence_level", "arousal_level", "dominance_level"))


def _ranked_centroids(epsilon: float):
    """The 27 centroids of a row in order of distance: place, archetype, distance, affinity; an array of 27 structs, so
    that nothing is exploded or shuffled to rank them."""
    points = [(f"{a}-{b}-{c}", LEVELS[a], LEVELS[b], LEVELS[c]) for a in LEVELS for b in LEVELS for c in LEVELS]
    far = lambda p: F.sqrt(F.pow(F.col("valence") - p[1], 2) + F.pow(F.col("arousal") - p[2], 2) + F.pow(F.col("dominance") - p[3], 2))
    each = F.array(*[F.struct(F.round(far(p), 9).alias("k"), F.lit(p[0]).alias("archetype"), far(p).alias("distance")) for p in points])
    return F.array_sort(each)


def archetype_neighbors(means: DataFrame, n: int = 3, epsilon: float = 1e-9) -> DataFrame:
    """The n nearest of the 27 centroids with distance and affinity."""
    rows = means.filter("valence is not null and arousal is not null and dominance is not null").withColumn("c", _ranked_centroids(epsilon))
    total = F.aggregate("c", F.lit(0.0), lambda t, x: t + 1 / (x["distance"] + epsilon))
    rows = rows.withColumn("total", total).select("work_id", "total", F.posexplode(F.slice("c", 1, n)).alias("i", "c"))
    return rows.select("work_id", "c.archetype", "c.distance", (1 / (F.col("c.distance") + epsilon) / F.col("total")).alias("affinity"), (F.col("i") + 1).alias("place"))


def archetype_confidence(means: DataFrame, least_tokens: int = 5, least_coverage: float = 0.2, epsilon: float = 1e-9) -> DataFrame:
    """How sure the archetype of a work's levels is: unavailable, boundary_sensitive, low, moderate or high.
    ``means``: work_id, the three means, n (matched), tokens."""
    rows = means.withColumn("c", _ranked_centroids(epsilon)).withColumn("coverage", F.col("n") / F.col("tokens"))
    names = F.concat_ws("-", *[level(F.col(d)) for d in ("valence", "arousal", "dominance")])
    edge = F.least(*[F.least(F.abs(F.col(d) - 0.4), F.abs(F.col(d) - 0.6)) for d in ("valence", "arousal", "dominance")])
    rows = rows.withColumn("archetype", names).withColumn("boundary", edge).withColumn("nearest", F.get("c", F.lit(0))["archetype"]).withColumn("margin", F.get("c", F.lit(1))["distance"] - F.get("c", F.lit(0))["distance"])
    own = F.get(F.filter("c", lambda x: x["archetype"] == F.col("archetype")), F.lit(0))["distance"]
    rows = rows.withColumn("distance", own)
    enough = (F.col("n") >= least_tokens) & (F.col("coverage") >= least_coverage)
    label = (
        F.when(~enough, "unavailable").when((F.col("boundary") <= 0.03) | (F.col("nearest") != F.col("archetype")), "boundary_sensitive").when(F.col("coverage") < 0.5, "low")
        .when((F.col("distance") <= 0.2) & (F.col("margin") >= 0.08) & (F.col("boundary") >= 0.08) & (F.col("coverage") >= 0.8), "high").otherwise("moderate")
    )
    return rows.select("work_id", "archetype", "nearest", "distance", "margin", "boundary", "coverage", label.alias("confidence"))


def lexical_character(summaries: DataFrame, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """(work_id, dimension, mean, level): low up to the first threshold of a dimension, high from the second."""
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("mean"), F.when(F.col(d) <= low, "low").when(F.col(d) >= high, "high").otherwise("moderate").alias("level")) for d, (low, high) in thresholds.items()])
    return summaries.select("work_id", F.explode(each).alias("x")).select("work_id", "x.*").filter("mean is not null")


def feature_weights(groups: dict[str, str]) -> dict[str, float]:
    """Equal weight to each group of features, shared equally inside it.  ``groups``: feature -> group."""
    size = {g: list(groups.values()).count(g) for g in groups.values()}
    return {f: 1 / len(size) / size[g] for f, g in groups.items()}


def reader_assessment(responses: DataFrame, measured: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Per assessment and dimension the mean answer on 0-1, its gap to the measured value and their relation; assessments
    that lack an answer, have one twice or one out of 1-5 are left out.

    ``responses``: assessment_id, work_id, item_id (its first letter is the dimension, four items each), value;
    ``measured``: work_id, dimension, measured."""
    good = F.col("value").between(1, 5)
    whole = responses.groupBy("assessment_id").agg(F.countDistinct("item_id").alias("items"), F.count("*").alias("n"), F.count_if(good).alias("good")).filter("items = 16 and n = 16 and good = 16")
    rows = responses.join(whole.select("assessment_id").hint("shuffle_merge"), "assessment_id").withColumn("dimension", F.left("item_id", F.lit(1)))
    scores = rows.groupBy("assessment_id", "work_id", "dimension").agg(((F.avg("value") - 1) / 4).alias("experienced"), F.stddev_pop("value").alias("sd"))
    joined = scores.join(measured.hint("shuffle_merge"), ["work_id", "dimension"])
    gap = F.col("experienced") - F.col("measured")
    relation = F.when(F.round(gap, 9) < -tolerance, "lower").when(F.round(gap, 9) > tolerance, "higher").otherwise("agreement")
    return joined.select("assessment_id", "work_id", "dimension", "experienced", "sd", "measured", gap.alias("gap"), relation.alias("relation"))


def signatures(assessed: DataFrame, order: list[str]) -> DataFrame:
    """Per assessment the relations of all dimensions in order, as a string: - lower, = agreement, + higher."""
    mark = F.when(F.col("relation") == "lower", "-").when(F.col("relation") == "higher", "+").otherwise("=")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("dimension"))
    parts = F.array_sort(F.collect_list(F.struct(place.alias("k"), F.concat("dimension", mark).alias("s"))))
    return assessed.groupBy("assessment_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("signature"))


def standardise(long: DataFrame, logged: list[str] = ()) -> DataFrame:
    """z of (id, feature, value), null-skipping; a spread of nearly 0 counts as 1."""
    value = F.when(F.col("feature").isin(*logged), F.log1p("value")).otherwise(F.col("value")) if logged else F.col("value")
    rows = long.withColumn("value", value)
    stats = rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    sd = F.when(F.col("sd") <= 1e-12, 1.0).otherwise(F.col("sd"))
    return rows.join(F.broadcast(stats), "feature").select("id", "feature", ((F.col("value") - F.col("mean")) / sd).alias("z"))  # a row a feature


def centroids(z: DataFrame, groups: DataFrame) -> DataFrame:
    return z.join(groups.hint("shuffle_merge"), "id").groupBy("poet", "feature").agg(F.avg("z").alias("z"))


def centre_distance(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Weighted distance of each row (id, z) from the centre, its features and their weight; no shuffle."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    add = lambda e: F.aggregate(e, F.lit(0.0), lambda t, x: t + x)
    there = add(F.zip_with("z", w, lambda z, w: F.when(z.isNotNull(), w).otherwise(0.0)))
    total = add(F.zip_with("z", w, lambda z, w: F.coalesce(z * z * w, F.lit(0.0))))
    return rows.select("id", F.sqrt(total / F.nullif(there, F.lit(0.0))).alias("distance"), F.size(F.filter("z", lambda z: z.isNotNull())).cast("bigint").alias("features"), there.alias("weight"))


def standard_vectors(rows: DataFrame) -> DataFrame:
    """(id, z) of (id, vector): elements less their mean over their spread, null-skipping; a spread of nearly 0 counts as
    1.  Two numbers a feature go through the driver."""
    each = rows.select(F.posexplode("vector").alias("i", "x"))
    stats = each.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).orderBy("i").collect()
    pairs = F.array(*[F.struct(F.lit(float(r["mean"] or 0.0)).alias("m"), F.lit(float(r["sd"]) if r["sd"] and r["sd"] > 1e-12 else 1.0).alias("s")) for r in stats])
    return rows.select("id", F.zip_with("vector", pairs, lambda x, p: (x.cast("double") - p["m"]) / p["s"]).alias("z"))


def nearest(queries: DataFrame, reference: DataFrame, weights: list[float], n: int = 10, least_weight: float = 0.6, block: int = 1024) -> DataFrame:
    """The n nearest reference rows of each query: root of sum(w (z1 - z2)^2) / sum(w) over the features that both have, if
    their weights come to ``least_weight``.  ``queries`` and ``reference``: id, z (array<double>, null elements allowed).

    Queries go to the tasks in blocks of about ``block``, one pass over the reference for each; a task keeps n a query, so
    that no pair is a row and no broadcast grows."""
    w = np.array(weights)
    blocks = max(1, -(-queries.count() // block))
    found = None
    for k in range(blocks):
        got = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()  # about ``block`` rows
        shared = queries.sparkSession.sparkContext.broadcast((got["id"].to_numpy(), _matrix(got["z"], len(w))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            known = ~np.isnan(x)
            zero = np.where(known, x, 0.0)
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0))] * len(ids)
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    other = batch.column("id").slice(lo, 4096).to_numpy()
                    y = _matrix(batch.column("z").slice(lo, 4096), len(w))
                    there = ~np.isnan(y)
                    y = np.where(there, y, 0.0)
                    weight = (known * w) @ there.T.astype(float)
                    total = (zero * zero * w) @ there.T.astype(float) + (known * w) @ (y * y).T - 2 * (zero * w) @ y.T
                    far = np.sqrt(np.maximum(total, 0) / np.where(weight > 0, weight, 1))
                    far[(weight < least_weight - 1e-12) | (ids[:, None] == other[None, :])] = np.inf
                    limit = np.partition(far, min(n, far.shape[1]) - 1, axis=1)[:, min(n, far.shape[1]) - 1]
                    for q in range(len(ids)):
                        some = np.flatnonzero((far[q] <= limit[q] + 1e-9) & np.isfinite(far[q]))
                        d, o, e = (np.concatenate([a, b]) for a, b in zip(best[q], (far[q, some], other[some], weight[q, some])))
                        order = np.lexsort((o, np.round(d, 9)))[:n]
                        best[q] = d[order], o[order], e[order]
            for q, (d, o, e) in enumerate(best):
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), ids[q])), pa.array(o), pa.array(d), pa.array(e)], names=["id", "other", "distance", "shared_weight"])

        near = reference.select("id", "z").mapInArrow(run, "id bigint, other bigint, distance double, shared_weight double")
        found = near if found is None else found.union(near)
    order = Window.partitionBy("id").orderBy(F.round("distance", 9), "other")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def _matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow column of arrays; nan for null."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def collection_neighbors(near: DataFrame, poets: DataFrame, groups: DataFrame) -> DataFrame:
    """Poets ranked by their mean distance over all works of a collection.  ``near``: id, other, distance; ``poets``: other,
    poet; ``groups``: id, collection."""
    rows = near.join(poets.hint("shuffle_merge"), "other").join(groups.hint("shuffle_merge"), "id")
    means = rows.groupBy("collection", "poet").agg(F.avg("distance").alias("distance"), F.countDistinct("id").alias("works"))
    order = Window.partitionBy("collection").orderBy(F.round("distance", 9), "poet")
    return means.withColumn("place", F.row_number().over(order))


def principal_components(rows: DataFrame, weights: list[float], k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Loadings [feature, k] and explained shares of ``rows`` (id, z): of z times the roots of the weights, nulls as 0, each
    component's sign fixed by its largest loading.  Tasks add up products of features, which are few."""
    d = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = np.nan_to_num(_matrix(batch.column("z"), d)) * np.sqrt(weights)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "x"])

    cells = rows.select("z").mapInArrow(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()  # d * d rows
    products = np.zeros(d * d)
    products[cells["cell"].to_numpy()] = cells["x"].to_numpy()
    values, columns = np.linalg.eigh(products.reshape(d, d))
    loadings = columns[:, ::-1][:, :k]
    loadings = loadings * np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    return loadings, values[::-1][:k] / max(values.sum(), 1e-300)


def weighted_z(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Adds x: z times the roots of the weights, nulls as 0."""
    roots = F.array(*[F.lit(math.sqrt(w)) for w in weights])
    return rows.withColumn("x", F.zip_with("z", roots, lambda z, r: F.coalesce(z, F.lit(0.0)) * r))


def project(rows: DataFrame, weights: list[float], loadings: np.ndarray) -> DataFrame:
    """id, the coordinates pc1, pc2, ... and the weight of the features that a row has."""
    along = lambda c: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    there = F.aggregate(F.zip_with("z", F.array(*[F.lit(float(w)) for w in weights]), lambda z, w: F.when(z.isNotNull(), w).otherwise(0.0)), F.lit(0.0), lambda t, v: t + v)
    return weighted_z(rows, weights).select("id", *[along(loadings[:, i]).alias(f"pc{i + 1}") for i in range(loadings.shape[1])], there.alias("weight"))


def normal_percentile(z):
    """Normal CDF by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)
