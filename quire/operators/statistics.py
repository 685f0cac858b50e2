"""Aggregates of evidence per work: profiles, coverage, categories, diversity, readability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, summary, syllables


def descriptive_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*summary(value))


def type_dedup(matches: DataFrame) -> DataFrame:
    """The first occurrence of each matched lookup form of a work."""
    first = Window.partitionBy("work_id", "form").orderBy("pos")
    return matches.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def coverage(matches: DataFrame) -> DataFrame:
    hit = F.col("value").isNotNull()
    counts = matches.groupBy("work_id").agg(F.count("*").alias("tokens"), F.countDistinct("form").alias("types"), F.count_if(hit).alias("matched_tokens"), F.countDistinct(F.when(hit, F.col("form"))).alias("matched_types"))
    return counts.withColumn("token_coverage", ratio("matched_tokens", "tokens")).withColumn("type_coverage", ratio("matched_types", "types"))


def six_profiles(evidence: DataFrame) -> DataFrame:
    """Statistics of ``value`` in three scopes (all, without stopwords, content words) and two weightings.

    ``evidence``: work_id, form, pos, value (null if unmatched), is_stopword, is_content.  Forms are counted per work first,
    so that a token counts as often as it stands there, and a type once.
    """
    return form_profiles(evidence.groupBy("work_id", "form", "is_stopword", "is_content").agg(F.count("*").alias("n"), F.first("value").alias("value")))


def weighted_moments(value: Column, times: Column) -> dict[str, Column]:
    """count, mean, sd, total of a value that stands ``times`` times.  Rows without a value or with times 0 don't count."""
    n, total = F.sum(F.when(value.isNotNull(), times).otherwise(0)), F.sum(value * times)
    mean = total / F.nullif(n, F.lit(0))
    sd = F.sqrt(F.greatest(F.sum(value * value * times) / F.nullif(n, F.lit(0)) - mean * mean, F.lit(0.0)))
    return {"count": n, "mean": mean, "sd": sd, "total": F.when(n > 0, total)}


def weighted_summary(value: Column, times: Column) -> Column:
    """count, mean, median, sd, minimum, q1, q3, maximum, total of a value that stands ``times`` times, a struct; one pass for all
    three quantiles.  Rows without a value or with times 0 don't count."""
    counted, m = F.when(value.isNotNull(), times).otherwise(0), weighted_moments(value, times)
    n, held = m["count"], F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), counted)
    there, many = F.when(counted > 0, value), lambda x: F.when(n > 1, x)
    parts = {"count": n, "mean": m["mean"], "median": F.get(held, F.lit(1)), "sd": many(m["sd"]), "minimum": F.min(there), "q1": many(F.get(held, F.lit(0))), "q3": many(F.get(held, F.lit(2))), "maximum": F.max(there), "total": m["total"]}
    return F.struct(*[x.alias(k) for k, x in parts.items()])


def _views(forms: DataFrame, scopes: dict[str, Column], values: dict[str, str]) -> DataFrame:
    """work_id, scope, weighting, dimension, eligible, s (``weighted_summary``): all views of a work's forms in one aggregate, as
    columns first, rows after it."""
    made = []
    for scope, inside in scopes.items():
        for weighting, n in (("token", F.col("n")), ("type", F.lit(1).cast("bigint"))):
            times = F.when(inside, n).otherwise(F.lit(0).cast("bigint"))
            made += [F.struct(F.lit(scope).alias("scope"), F.lit(weighting).alias("weighting"), F.lit(d).alias("dimension"), F.sum(times).alias("eligible"), weighted_summary(F.col(c), times).alias("s")) for d, c in values.items()]
    return forms.groupBy("work_id").agg(F.array(*made).alias("v")).select("work_id", F.explode("v").alias("v")).select("work_id", "v.*")


#: Fewer matched tokens are sparse.
SPARSE = 5


def form_profiles(forms: DataFrame) -> DataFrame:
    """``six_profiles`` of counted forms: work_id, form, n, value, is_stopword, is_content."""
    scopes = {"all": F.lit(True), "without_stopwords": ~F.col("is_stopword"), "content": F.col("is_content") & ~F.col("is_stopword")}
    rows = _views(forms, scopes, {"value": "value"}).filter("eligible > 0")
    s = lambda c: F.col(f"s.{c}").alias(c)
    return rows.select("work_id", "scope", "weighting", "eligible", F.col("s.count").alias("matched"), s("mean"), s("median"), s("sd"), s("q1"), s("q3"), s("total"), ratio("s.count", "eligible").alias("coverage"), (100 * F.col("s.total") / F.nullif("eligible", F.lit(0))).alias("per_100"))


def vad_profiles(forms: DataFrame) -> DataFrame:
    """Statistics of three dimensions, with and without stopwords, by token and by type, on the lexicon's scale of 1 to 9 and on
    0 to 1, and whether they rest on few words.  ``forms``: work_id, form, n, value, arousal, dominance, is_stopword."""
    rows = _views(forms, {"all": F.lit(True), "without_stopwords": ~F.col("is_stopword")}, {"valence": "value", "arousal": "arousal", "dominance": "dominance"})
    names = ("count", "mean", "median", "sd", "minimum", "q1", "q3", "maximum")
    original = lambda c: (8 * F.col(f"s.{c}") + (0 if c == "sd" else 1)).alias(f"original_{c}")
    return rows.filter("s.count > 0").select("work_id", F.col("scope").alias("view"), "weighting", "dimension", *[F.col(f"s.{c}").alias(c) for c in names], *[original(c) for c in names[1:]], (F.col("s.count") < SPARSE).alias("is_sparse"))


def midpoint_loads(matches: DataFrame) -> DataFrame:
    """Sums above and below 0.5, net and absolute, per observation, and the mean distance from the mean."""
    rows = matches.filter("value is not null").withColumn("centre", F.avg("value").over(Window.partitionBy("work_id")))
    up, down = F.sum(F.greatest(F.col("value") - 0.5, F.lit(0.0))), F.sum(F.greatest(0.5 - F.col("value"), F.lit(0.0)))
    return rows.groupBy("work_id").agg(F.count("*").alias("n"), up.alias("above"), down.alias("below"), (up - down).alias("net"), (up + down).alias("absolute"), ((up - down) / F.count("*")).alias("net_each"), F.avg(F.abs(F.col("value") - F.col("centre"))).alias("mean_distance"))


def category_stats(matches: DataFrame) -> DataFrame:
    """Tokens and types of each category (array ``categories``), with shares of lexical and of bearing tokens."""
    bearing = matches.groupBy("work_id").agg(F.count("*").alias("lexical"), F.count_if(F.size("categories") > 0).alias("bearing"))
    each = matches.withColumn("category", F.explode("categories")).groupBy("work_id", "category").agg(F.count("*").alias("tokens"), F.countDistinct("form").alias("types"))
    joined = each.join(bearing.hint("shuffle_merge"), "work_id")
    return joined.select("work_id", "category", "tokens", "types", ratio("tokens", "lexical").alias("share_of_lexical"), ratio("tokens", "bearing").alias("share_of_bearing"))


def top_terms(matches: DataFrame, keys: list[str], n: int, descending: bool = True) -> DataFrame:
    """The n most (or least) frequent forms for each key, ties in order of the form."""
    counts = matches.groupBy(*keys, "form").agg(F.count("*").alias("frequency"))
    order = Window.partitionBy(*keys).orderBy(F.desc("frequency") if descending else F.asc("frequency"), "form")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def norm_bands(matches: DataFrame, works: DataFrame, bands: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """Count and share of values in [low, high) of each band; empty bands show 0."""
    label = F.coalesce(*[F.when((F.col("value") >= (low if low is not None else float("-inf"))) & (F.col("value") < (high if high is not None else float("inf"))), F.lit(name)) for name, low, high in bands])
    counts = matches.filter("value is not null").groupBy("work_id", label.alias("band")).agg(F.count("*").alias("n"))
    every = works.select("work_id", F.explode(F.array(*[F.lit(b[0]) for b in bands])).alias("band"))
    full = every.join(counts.hint("shuffle_merge"), ["work_id", "band"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("work_id"))))


def by_structure(matches: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """Statistics per line or stanza; units without evidence stay with count 0.  ``matches`` are of the units: a unit is a row
    without a value beside them, so one grouping serves both."""
    rows = matches.select("work_id", unit, "value").unionByName(units.select("work_id", unit, F.lit(None).cast("double").alias("value")))
    return rows.groupBy("work_id", unit).agg(*summary("value"))


def in_units(rows: DataFrame) -> DataFrame:
    """Rows of lines (stanza_no 0: a blank one), each under its line and again under its stanza: ``unit`` has line_no or stanza_no."""
    none = F.lit(None).cast("int")
    line = F.struct(F.col("line_no").cast("int").alias("line_no"), none.alias("stanza_no"))
    stanza = F.struct(none.alias("line_no"), F.col("stanza_no").cast("int").alias("stanza_no"))
    units = F.when(F.col("stanza_no") > 0, F.array(line, stanza)).otherwise(F.array(line))
    return rows.select("*", F.explode(units).alias("unit"))


def ordered_means(rows: DataFrame) -> DataFrame:
    """work_id, mean of ``value`` in each work, summed up in order of ``pos``: the same bits however the rows are dealt."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    return rows.filter("value is not null").groupBy("work_id").agg((F.aggregate(held, F.lit(0.0), lambda s, v: s + v) / F.count("*")).alias("mean"))


def spearman(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; null for fewer than three pairs."""

    def average_rank(c: str):
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    ranked = pairs.withColumn("_a", average_rank(a)).withColumn("_b", average_rank(b))
    return ranked.groupBy(*keys).agg(F.count("*").alias("pairs"), F.when(F.count("*") >= 3, F.corr("_a", "_b")).alias("rho"))


def diversity(token_rows: DataFrame, window: int = 50, draws: int = 42) -> DataFrame:
    """Types, TTR, MATTR and HD-D of each work.

    MATTR counts a token in the windows where it is the first of its form: a closed form on the distance
    to the form's previous place, so no window is built.  HD-D folds the chance to miss a form in all draws.
    """
    same = Window.partitionBy("work_id", "form").orderBy("pos")
    n = F.count("*").over(Window.partitionBy("work_id"))
    rows = token_rows.select("work_id", "form", "pos", F.coalesce(F.lag("pos").over(same), F.lit(0)).alias("prev"), n.alias("n"))
    first_in = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("n") - window + 1) - F.greatest(F.col("prev"), F.col("pos") - window))
    missed = F.aggregate(F.sequence(F.lit(0), F.lit(draws - 1)), F.lit(1.0), lambda a, i: a * F.greatest(F.col("n") - F.col("f") - i, F.lit(0)) / (F.col("n") - i))
    forms = rows.groupBy("work_id", "form").agg(F.max("n").alias("n"), F.count("*").alias("f"), F.sum(first_in).alias("firsts"))
    forms = forms.withColumn("seen", F.when(F.col("n") >= draws, 1 - missed))
    per = forms.groupBy("work_id").agg(F.max("n").alias("tokens"), F.count("*").alias("types"), F.sum("firsts").alias("firsts"), F.sum("seen").alias("seen"))
    mattr = F.when(F.col("tokens") >= window, F.col("firsts") / (window * (F.col("tokens") - window + 1)))
    return per.select("work_id", "tokens", "types", ratio("types", "tokens").alias("ttr"), mattr.alias("mattr"), (F.col("seen") / draws).alias("hdd"))


def mtld(token_rows: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Mean of forward and reverse factor lengths; ``pos`` counts a work's tokens from 1.  A form is new in a factor if its last place stands before the factor's
    start, so the fold over a work carries three numbers and takes time in proportion to its tokens."""

    def one_way(places):
        zero = F.struct(F.lit(0.0).alias("factors"), F.lit(1).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("types"))

        def step(acc, x):
            n, types = acc["n"] + 1, acc["types"] + (x["prev"] < acc["start"]).cast("int")
            full = types / n <= threshold
            return F.when(full, F.struct((acc["factors"] + 1).alias("factors"), (x["at"] + 1).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("types"))).otherwise(F.struct(acc["factors"].alias("factors"), acc["start"].alias("start"), n.alias("n"), types.alias("types")))

        def length(end):
            rest = F.when(end["n"] > 0, (1 - end["types"] / end["n"]) / (1 - threshold)).otherwise(0.0)
            return F.col("n") / F.nullif(end["factors"] + rest, F.lit(0.0))

        return F.aggregate(places, zero, step, length)

    same = Window.partitionBy("work_id", "form").orderBy("pos")
    rows = token_rows.select("work_id", F.col("pos").cast("int").alias("pos"), F.coalesce(F.lag("pos").over(same), F.lit(0)).cast("int").alias("before"), F.lead("pos").over(same).cast("int").alias("after"))
    works = rows.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("pos", "before", "after"))).alias("p")).withColumn("n", F.size("p"))
    forward = F.transform("p", lambda x: F.struct(x["pos"].alias("at"), x["before"].alias("prev")))
    backward = F.transform(F.reverse("p"), lambda x: F.struct((F.col("n") + 1 - x["pos"]).alias("at"), F.coalesce(F.col("n") + 1 - x["after"], F.lit(0)).alias("prev")))
    return works.select("work_id", F.col("n").alias("tokens"), ((one_way(forward) + one_way(backward)) / 2).alias("mtld"))


def readability(words: DataFrame, sentence_counts: DataFrame) -> DataFrame:
    """Counts and the usual indices.  ``words``: work_id, form (letters); ``sentence_counts``: work_id, sentences."""
    s = syllables(F.col("form"))
    counts = words.groupBy("work_id").agg(F.count("*").alias("words"), F.sum(s).alias("syllables"), F.sum(F.length("form")).alias("letters"), F.count_if(s >= 3).alias("long_words"))
    c = counts.join(sentence_counts.hint("shuffle_merge"), "work_id")
    per_sentence, per_word = ratio("words", "sentences"), ratio("syllables", "words")
    return c.select(
        "work_id", "words", "sentences", "syllables", "letters", "long_words",
        (206.835 - 1.015 * per_sentence - 84.6 * per_word).alias("flesch"), (0.39 * per_sentence + 11.8 * per_word - 15.59).alias("fk_grade"),
        (0.4 * (per_sentence + 100 * ratio("long_words", "words"))).alias("fog"), (4.71 * ratio("letters", "words") + 0.5 * per_sentence - 21.43).alias("ari"),
        (5.88 * ratio("letters", "words") - 29.6 * ratio("sentences", "words") - 15.8).alias("coleman_liau"), F.when(F.col("sentences") >= 30, 1.043 * F.sqrt(F.col("long_words") * 30 / F.col("sentences")) + 3.1291).alias("smog"),
    )


def contributors(matches: DataFrame, n: int = 5) -> DataFrame:
    """Terms that pull a work's mean most: effect of leaving the term out, n upwards and n downwards."""
    terms = matches.filter("value is not null").groupBy("work_id", "form").agg(F.count("*").alias("times"), F.sum("value").alias("s"), F.first("value").alias("value"))
    work = Window.partitionBy("work_id")
    all_s, all_n = F.sum("s").over(work), F.sum("times").over(work)
    pull = F.col("times") * (F.col("value") - 0.5)
    rows = terms.withColumn("effect", all_s / all_n - ratio(all_s - F.col("s"), all_n - F.col("times"))).withColumn("pull", pull).withColumn("direction", F.when(pull > 0, "up").when(pull < 0, "down").otherwise("neutral"))
    order = Window.partitionBy("work_id", "direction").orderBy(F.desc(F.abs("pull")), "form")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("work_id", "direction", "place", "form", "times", "pull", "effect")
