"""Works to lines, stanzas, tokens and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_form, ratio, strip_edges, text_lines

TOKEN = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*|[^\\s\\p{L}\\p{N}]"
CONTENT = ("NOUN", "VERB", "ADJ", "ADV")
FUNCTION = ("ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "SCONJ")


def lines(works: DataFrame) -> DataFrame:
    """work_id, line_no, line, is_blank, indent of each physical line."""
    each = works.select("work_id", F.posexplode(text_lines(F.col("text"))).alias("i", "line"))
    return each.select("work_id", (F.col("i") + 1).alias("line_no"), "line", (F.trim("line") == "").alias("is_blank"), (F.length("line") - F.length(F.ltrim("line"))).alias("indent"))


def stanzas(line_rows: DataFrame) -> DataFrame:
    """Adds stanza_no: maximal runs of lines that aren't blank; blank lines have 0."""
    by = Window.partitionBy("work_id").orderBy("line_no")
    begins = ~F.col("is_blank") & F.coalesce(F.lag("is_blank").over(by), F.lit(True))
    number = F.sum(begins.cast("int")).over(by)
    return line_rows.withColumn("stanza_no", F.when(F.col("is_blank"), 0).otherwise(number).cast("int"))


def strip_line_edges(works: DataFrame) -> DataFrame:
    return works.withColumn("text", F.array_join(F.transform(text_lines(F.col("text")), lambda x: F.trim(x)), "\n"))


def tokens(line_rows: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """A row for each token: place in line and work, surface, form, flags."""
    each = line_rows.select("work_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(pattern), 0)).alias("i", "surface"))
    by = Window.partitionBy("work_id").orderBy("line_no", "i")
    form = normal_form(F.col("surface"))
    return each.select(
        "work_id", F.row_number().over(by).alias("pos"), "line_no", (F.col("i") + 1).alias("line_pos"), "surface", form.alias("form"), strip_edges(form).alias("bare"),
        (~F.col("surface").rlike("[\\p{L}\\p{N}]")).alias("is_punct"), F.col("surface").rlike("^[0-9]+$").alias("is_numeric"), F.col("surface").rlike("^\\p{L}+$").alias("is_alpha"),
    )


def work_tokens(works: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """``tokens`` of whole works, numbered inside each work's row, so that nothing is shuffled."""
    lines = F.transform(text_lines(F.col("text")), lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda w, j: F.struct((i + 1).alias("line_no"), (j + 1).alias("line_pos"), w.alias("surface"))))
    each = works.select("work_id", F.posexplode(F.flatten(lines)).alias("i", "t"))
    form = normal_form(F.col("t.surface"))
    return each.select(
        "work_id", (F.col("i") + 1).alias("pos"), "t.line_no", "t.line_pos", "t.surface", form.alias("form"), strip_edges(form).alias("bare"),
        (~F.col("t.surface").rlike("[\\p{L}\\p{N}]")).alias("is_punct"), F.col("t.surface").rlike("^[0-9]+$").alias("is_numeric"), F.col("t.surface").rlike("^\\p{L}+$").alias("is_alpha"),
    )


def plain_tokens(works: DataFrame, pattern: str) -> DataFrame:
    """work_id, pos, surface, form of the tokens of ``work_tokens`` for a pattern that matches no line end: found in the whole
    text at once."""
    each = works.select("work_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("i", "surface"))
    return each.select("work_id", (F.col("i") + 1).alias("pos"), "surface", normal_form(F.col("surface")).alias("form"))


def line_tokens(works: DataFrame, pattern: str) -> DataFrame:
    """work_id, line_no, line_pos, surface, form, next (the surface after it in the line) of ``work_tokens``, not numbered in the work."""
    found = works.select("work_id", F.posexplode(text_lines(F.col("text"))).alias("n", "line")).select("work_id", "n", F.regexp_extract_all("line", F.lit(pattern), 0).alias("ws"))
    each = found.select("work_id", "n", "ws", F.posexplode("ws").alias("i", "surface"))
    return each.select("work_id", (F.col("n") + 1).alias("line_no"), (F.col("i") + 1).alias("line_pos"), "surface", normal_form(F.col("surface")).alias("form"), F.get("ws", F.col("i") + 1).alias("next"))


def eligibility(token_rows: DataFrame) -> DataFrame:
    """Adds eligible and reason: lexical, or numeric with a letter."""
    reason = F.when(F.col("is_punct"), "punctuation").when(F.col("is_numeric") & ~F.col("form").rlike("\\p{L}"), "numeric").otherwise("eligible")
    return token_rows.withColumn("reason", reason).withColumn("eligible", reason == "eligible")


def annotate_pos_lemma(token_rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """Part of speech and lemma from a table (form, tag, lemma); unlisted words are X and their own lemma.
    The table comes from files: its size decides how it is joined."""
    joined = token_rows.join(annotations, "form", "left")
    return joined.withColumn("tag", F.coalesce("tag", F.lit("X"))).withColumn("lemma", F.coalesce("lemma", "form"))


def token_role(token_rows: DataFrame) -> DataFrame:
    role = F.when(F.col("is_punct"), "non-lexical").when(F.col("tag").isin(*CONTENT), "content").when(F.col("tag").isin(*FUNCTION), "function").otherwise("other")
    return token_rows.withColumn("role", role)


def sentences(works: DataFrame) -> DataFrame:
    """Units between sentence marks followed by white space."""
    parts = F.filter(F.transform(F.split("text", "(?<=[.!?])\\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return works.select("work_id", F.posexplode(parts).alias("i", "sentence")).select("work_id", (F.col("i") + 1).alias("sentence_no"), "sentence")


def processing_coverage(token_rows: DataFrame, sentence_rows: DataFrame) -> DataFrame:
    lexical = F.count_if(~F.col("is_punct"))
    counts = token_rows.groupBy("work_id").agg(F.count("*").alias("tokens"), lexical.alias("lexical_tokens"), F.countDistinct(F.when(~F.col("is_punct"), F.col("form"))).alias("types"))
    n = sentence_rows.groupBy("work_id").agg(F.count("*").alias("sentences"))
    return counts.join(n.hint("shuffle_merge"), "work_id", "left").withColumn("lexical_rate", ratio("lexical_tokens", "tokens"))


def stopword_policy(standard: DataFrame, added: DataFrame, removed: DataFrame, protected: DataFrame) -> DataFrame:
    """Active words: standard and added, less removed and protected ones (tables of ``word``)."""
    return standard.union(added).distinct().join(removed, "word", "left_anti").join(protected, "word", "left_anti")


def text_versions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(path, sha256, imported, is_active): known contents are not imported again, the newest is active."""
    new = incoming.join(stored.select("path", "sha256").hint("shuffle_merge"), ["path", "sha256"], "left_anti")
    newest = Window.partitionBy("path").orderBy(F.desc("imported"), "sha256")
    return stored.unionByName(new.select(*stored.columns)).withColumn("is_active", F.row_number().over(newest) == 1)
