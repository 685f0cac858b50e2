"""Sound and metre."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .meter import FEET


def rhyme_part(phones):
    """Phones from the last primary-stressed vowel on, else secondary, else any; stress digits dropped."""
    last = lambda pattern: F.array_max(F.filter(F.transform(phones, lambda p, i: F.when(p.rlike(pattern), i)), lambda i: i.isNotNull()))
    at = F.coalesce(last("1$"), last("2$"), last("0$"))
    return F.when(at.isNotNull(), F.transform(F.slice(phones, at + 1, F.size(phones)), lambda p: F.regexp_replace(p, "[012]$", "")))


def eye_rime(word):
    return F.regexp_extract(word, "([aeiouy][^aeiouy]*e?)$", 1)


def line_endings(token_rows: DataFrame) -> DataFrame:
    """The last word of each line."""
    return token_rows.groupBy("work_id", "line_no").agg(F.max_by("form", "pos").alias("form"))


def rhyme_scheme(endings: DataFrame) -> DataFrame:
    """Adds label: A, B, ... by first use of rhyme parts found at least twice, x for others, ? unresolved."""
    part = Window.partitionBy("work_id", "part")
    rows = endings.withColumn("n", F.count("*").over(part)).withColumn("first", F.min("line_no").over(part))
    used = F.col("part").isNotNull() & (F.col("n") > 1)
    number = F.dense_rank().over(Window.partitionBy("work_id", used).orderBy("first"))
    letter = F.expr("concat(repeat(chr(cast(65 + (k - 1) % 26 as int)), cast(floor((k - 1) / 26) as int) + 1))")
    rows = rows.withColumn("k", number)
    return rows.withColumn("label", F.when(F.col("part").isNull(), "?").when(F.col("n") > 1, letter).otherwise("x")).drop("n", "first", "k")


def refrains(line_rows: DataFrame) -> DataFrame:
    """Lines found at least twice in a work after case and white space folding, numbered by first use."""
    folded = line_rows.filter("trim(line) <> ''").withColumn("norm", F.regexp_replace(F.lower(F.trim("line")), "\\s+", " "))
    same = Window.partitionBy("work_id", "norm")
    rows = folded.withColumn("times", F.count("*").over(same)).withColumn("first", F.min("line_no").over(same)).filter("times > 1")
    return rows.withColumn("refrain", F.dense_rank().over(Window.partitionBy("work_id").orderBy("first"))).select("work_id", "line_no", "refrain", "times")


def sound_repetition(sounds: DataFrame) -> DataFrame:
    """Share of a line's sounds (work_id, line_no, sound) that repeat in it."""
    counts = sounds.groupBy("work_id", "line_no", "sound").agg(F.count("*").alias("n"))
    return counts.groupBy("work_id", "line_no").agg(F.sum("n").alias("sounds"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated")).withColumn("density", F.col("repeated") / F.col("sounds"))


def internal_rhymes(words: DataFrame) -> DataFrame:
    """Per line and rhyme part: words and pairs of different words in it, counted without listing pairs."""
    forms = words.groupBy("work_id", "line_no", "part", "form").agg(F.count("*").alias("n"))
    parts = forms.groupBy("work_id", "line_no", "part").agg(F.sum("n").alias("words"), ((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))) / 2).cast("bigint").alias("pairs"))
    return parts.filter("pairs > 0")


def meter_templates(spark, most_feet: int = 8) -> DataFrame:
    rows = spark.createDataFrame(list(FEET.items()), "pattern string, foot string")
    return rows.withColumn("feet", F.explode(F.sequence(F.lit(1), F.lit(most_feet)))).withColumn("template", F.expr("repeat(foot, feet)"))


def stress_clash_lapse(syllable_rows: DataFrame) -> DataFrame:
    """Clashes (two neighbours of .68 or more) and lapses (runs of three or more below .42) per line.
    ``syllable_rows``: work_id, line_no, pos, prominence."""
    by = Window.partitionBy("work_id", "line_no").orderBy("pos")
    rows = syllable_rows.withColumn("strong", F.col("prominence") >= 0.68).withColumn("weak", F.col("prominence") < 0.42)
    rows = rows.withColumn("clash", F.col("strong") & F.coalesce(F.lag("strong").over(by), F.lit(False)))
    rows = rows.withColumn("island", F.sum((~F.col("weak")).cast("int")).over(by))
    runs = rows.groupBy("work_id", "line_no", "island").agg(F.count_if("weak").alias("run"), F.count_if("clash").alias("clashes"))
    return runs.groupBy("work_id", "line_no").agg(F.sum("clashes").alias("clashes"), F.count_if(F.col("run") >= 3).alias("lapses"))
