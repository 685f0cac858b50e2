"""Queries over many works: manifests, profiles of collections, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

from ..functions.columns import ratio


def corpus_manifest(works: DataFrame) -> DataFrame:
    """Bytes, hashes of the text and of its canonical form (line ends as \\n), characters, lines, words and, in order, the warning
    codes that the work alone gives."""
    lines = F.split("text", "\n")
    words = F.size(F.regexp_extract_all("text", F.lit("\\p{L}+"), 0))
    rows = works.select("work_id", "poet", F.octet_length("text").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.sha2(F.regexp_replace("text", "\r\n|\r", "\n").cast("binary"), 256).alias("canonical_sha256"), F.char_length("text").alias("chars"), F.size(lines).alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias("filled_lines"), words.alias("words"))
    codes = F.array(F.when(F.col("words") == 0, "empty"), F.when((F.col("words") > 5000) | (F.col("filled_lines") > 500), "long"), F.when((F.col("words") > 0) & ((F.col("words") < 20) | (F.col("filled_lines") < 4)), "short"))
    return rows.withColumn("codes", F.filter(codes, lambda c: c.isNotNull()))


def corpus_issues(manifest: DataFrame) -> DataFrame:
    """(work_id, level, code): empty, short, long and duplicate works.  Copies are found by a count of each canonical text, so one
    that a large part of the corpus shares is a row a task."""
    many = manifest.groupBy("canonical_sha256").agg(F.count("*").alias("same")).filter("same > 1")
    joined = manifest.join(many.hint("shuffle_merge"), "canonical_sha256", "left")
    codes = F.concat("codes", F.when(F.col("same") > 1, F.array(F.lit("duplicate_text"))).otherwise(F.array().cast("array<string>")))
    return joined.select("work_id", F.explode(codes).alias("code")).select("work_id", F.when(F.col("code") == "empty", "error").otherwise("warning").alias("level"), "code")


def fingerprint(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint): a digest of each key's works that no order or partitioning changes, and one byte of one work does.

    A hash tree: a work's leaf is the hash of its id and canonical text; leaves with the same first six hexadecimal digits, in
    order, make a node, nodes with the same first three the next, and those, 4,096 at most, the fingerprint.  So no group holds
    all works: a node has 4,096 children, or a work in 16.7 million."""
    rows = manifest.select(*keys, F.sha2(F.concat_ws(":", F.col("work_id").cast("string"), F.col("canonical_sha256")), 256).alias("leaf"))
    node = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256).alias("digest")
    first = rows.groupBy(*keys, F.left("leaf", F.lit(6)).alias("at")).agg(node("leaf"))
    second = first.groupBy(*keys, F.left("at", F.lit(3)).alias("at")).agg(node(F.concat("at", "digest")))
    return second.groupBy(*keys).agg(node(F.concat("at", "digest"))).withColumnRenamed("digest", "fingerprint")


def release_summary(manifest: DataFrame) -> DataFrame:
    """Per poet: works, bytes, words, distinct texts, works with each warning code, and fingerprint."""
    codes = [F.count_if(F.array_contains("codes", c)).alias(c) for c in ("empty", "long", "short")]
    totals = manifest.groupBy("poet").agg(F.count("*").alias("works"), F.sum("bytes").alias("bytes"), F.sum("words").alias("words"), F.countDistinct("sha256").alias("texts"), *codes)
    t, f = totals.alias("t"), fingerprint(manifest, ["poet"]).hint("shuffle_merge").alias("f")
    return t.join(f, F.col("t.poet").eqNullSafe(F.col("f.poet"))).select("t.*", "fingerprint")


def release_fingerprint(manifest: DataFrame) -> DataFrame:
    """The whole release: works, bytes, issues by code, and fingerprint; one row."""
    issues = corpus_issues(manifest).groupBy().agg(*[F.count_if(F.col("code") == c).alias(c) for c in ("empty", "long", "short", "duplicate_text")])
    totals = manifest.groupBy().agg(F.count("*").alias("works"), F.sum("bytes").alias("bytes"))
    one = lambda df: df.withColumn("k", F.lit(0))  # three rows of one table each
    return one(totals).join(one(issues).hint("shuffle_merge"), "k").join(one(fingerprint(manifest, [])).hint("shuffle_merge"), "k", "left").drop("k")


def incremental(manifest: DataFrame, profiles: DataFrame) -> DataFrame:
    """(work_id, sha256, action): works with a known (id, hash) are reused, the rest is to do."""
    known = profiles.select("work_id", "sha256").distinct().withColumn("_known", F.lit(True))
    joined = manifest.select("work_id", "sha256").join(known.hint("shuffle_merge"), ["work_id", "sha256"], "left")
    return joined.select("work_id", "sha256", F.when(F.col("_known"), "reuse").otherwise("todo").alias("action"))


def pooled_profiles(work_metrics: DataFrame) -> DataFrame:
    """Per poet: pooled mean, pooled SD rebuilt from (mean, sd, n), and the mean and spread of work means.

    ``work_metrics``: poet, work_id, n, mean, sd.  The pooled SD is withheld if a work lacks its SD.
    Sums of n, n*mean and n*(sd^2 + mean^2) make it one aggregate.
    """
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    square = F.sum(F.col("n") * (F.col("sd") * F.col("sd") + F.col("mean") * F.col("mean"))) / n
    spread = F.when(F.count("sd") == F.count("*"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))
    works = F.count("*")
    return work_metrics.filter("n > 0").groupBy("poet").agg(works.alias("works"), n.alias("n"), mean.alias("pooled_mean"), spread.alias("pooled_sd"), F.avg("mean").alias("work_mean"), F.when(works > 1, F.stddev_pop("mean")).alias("work_sd"), F.percentile("mean", F.lit(0.5)).alias("work_median"), F.min("mean").alias("work_min"), F.max("mean").alias("work_max"))


def category_prevalence(results: DataFrame) -> DataFrame:
    """(category, works, share) of one categorical result a work."""
    counts = results.groupBy("category").agg(F.count("*").alias("works"))
    return counts.withColumn("share", ratio(F.col("works"), F.sum("works").over(Window.partitionBy())))  # a row a category


def metric_deltas(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """value_a, value_b, delta and absolute delta on null-safe keys."""
    x, y = a.alias("x"), b.hint("shuffle_merge").alias("y")
    on = None
    for k in keys:
        same = F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
        on = same if on is None else on & same
    j = x.join(y, on, how)
    delta = F.col("y.value") - F.col("x.value")
    return j.select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], F.col("x.value").alias("value_a"), F.col("y.value").alias("value_b"), delta.alias("delta"), F.abs(delta).alias("absolute"))


def set_comparison(metrics: DataFrame) -> DataFrame:
    """Per metric over works: mean, spread and range, null for fewer than two."""
    n = F.count("value")
    return metrics.groupBy("metric").agg(n.alias("works"), F.avg("value").alias("mean"), F.when(n > 1, F.stddev_pop("value")).alias("sd"), F.when(n > 1, F.max("value") - F.min("value")).alias("range"))


def metric_pivot(metrics: DataFrame, names: list[str]) -> DataFrame:
    return metrics.groupBy("work_id").pivot("metric", names).agg(F.first("value"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run (by time, then id) of each key."""
    last = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def rank_with_margin(scores: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "name")
    return scores.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.col("score") - F.lead("score").over(order))


def mid_ranks(points: DataFrame, value: str) -> DataFrame:
    """(d, p): the mid-rank percentile of each distinct value, rounded to 9 digits.

    Values are dealt into ranges, so ties lie in one; a range's place is the sum of the counts of those before it, a row a
    range, and inside a range its values are ranked in their own task."""
    counts = points.filter(F.col(value).isNotNull()).groupBy((F.round(value, 9) + F.lit(0.0)).alias("d")).agg(F.count("*").alias("n"))
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(counts.repartitionByRange(width, "d").withColumn("slot", F.spark_partition_id()), "ranges")
    slots = dealt.groupBy("slot").agg(F.sum("n").alias("k"))
    slots = slots.select("slot", (F.sum("k").over(Window.orderBy("slot")) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy()).alias("all"))  # a row a range
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("d"))
    return dealt.join(F.broadcast(slots), "slot").select("d", ((F.col("before") + upto - F.col("n") / 2) / F.col("all")).alias("p"))


def characteristicity(points: DataFrame) -> DataFrame:
    """Mid-rank percentile of each distance, and what it lacks to 1; null for a null distance.  ``points``: id, distance."""
    ranks = mid_ranks(points, "distance").hint("shuffle_merge")
    found = points.join(ranks, F.round("distance", 9) + F.lit(0.0) == F.col("d"), "left")
    return found.select("id", "distance", F.col("p").alias("distinctive"), (1 - F.col("p")).alias("characteristic"))


def browse(points: DataFrame, query: str) -> DataFrame:
    return points.filter(F.lower(F.concat_ws(" ", "title", "poet")).contains(query.lower()))
