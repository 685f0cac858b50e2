"""The tables that queries start from: works, tokens and norms derived from the vocabulary.

Word norms are licensed and absent, so queries derive deterministic ones from md5 digits of each word of
the corpus's own vocabulary.  ``PRELUDE`` states the same tables in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grams, matching, structure
from ..sources.tables import kept

STOPWORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"]
PROTECTED = ["not", "is"]
TAGS = ["NOUN", "VERB", "ADJ", "ADV", "DET", "PRON", "ADP", "X"]
CATEGORIES = ["anger", "fear", "joy", "trust"]
LETTERS = "\\p{L}+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """All documents, or those of one language for rules that hold for it alone."""
    docs = read(spark, sf_dir, "documents")
    docs = docs.filter(F.col("lang") == lang) if lang else docs
    return docs.select(F.col("doc_id").alias("work_id"), F.col("source").alias("poet"), "text")


def by_work(rows: DataFrame) -> DataFrame:
    """Rows dealt by work.  Texts are dealt before they fall into tokens, whatever row groups they are read in: what is
    counted in a work needs no other exchange.  The number of tasks is fixed, as tokens take far more than the texts' bytes tell."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "work_id")


def words(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """work_id, pos, line_no, line_pos, surface, form of runs of letters; no token is shuffled."""
    return structure.work_tokens(by_work(works(spark, sf_dir, lang)), LETTERS).select("work_id", "pos", "line_no", "line_pos", "surface", "form")


def plain_words(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """work_id, pos, surface, form of ``words``, without looking for lines."""
    return structure.plain_tokens(by_work(works(spark, sf_dir, lang)), LETTERS)


def line_words(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """work_id, line_no, line_pos, surface, form, next of ``words``, not numbered in the work."""
    return structure.line_tokens(by_work(works(spark, sf_dir, lang)), LETTERS)


def coded_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works' words as numbers, written once a session and dealt evenly, for queries that go through them several times."""
    return kept(spark, f"coded {sf_dir}", lambda: grams.coded(by_work(works(spark, sf_dir)), LETTERS), works(spark, sf_dir))


def digit(column, at: int, length: int):
    return F.conv(F.substring(F.md5(F.col(column).cast("binary")), at, length), 16, 10).cast("int")


def lexicon(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """form, tag, lemma, listed, value, arousal, dominance, categories of every word of the works: what a
    tagger and the lexicon files would give, derived once a session and written out."""

    def make() -> DataFrame:
        forms = plain_words(spark, sf_dir, lang).select("form").distinct()
        some = F.filter(F.array(*[F.when(digit("form", 20 + i, 1) < 4, F.lit(c)) for i, c in enumerate(CATEGORIES)]), lambda c: c.isNotNull())
        listed = digit("form", 5, 1) < 8
        tag = F.element_at(F.array(*[F.lit(t) for t in TAGS]), digit("form", 14, 1) % 8 + 1)
        scores = [F.when(listed, digit("form", at, 4) / 65535).alias(name) for name, at in (("value", 1), ("arousal", 6), ("dominance", 10))]
        return forms.select("form", tag.alias("tag"), F.regexp_replace("form", "(ing|ed|s)$", "").alias("lemma"), listed.alias("listed"), *scores, F.when(listed, some).alias("categories"))

    return kept(spark, f"lexicon {sf_dir} {lang}", make)


def norms(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """form, value, arousal, dominance, categories for the half of the words that is listed."""
    return lexicon(spark, sf_dir, lang).filter("listed").select("form", "value", "arousal", "dominance", "categories")


def tags(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    return lexicon(spark, sf_dir, lang).select("form", "tag", "lemma")


def matches(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    return matching.match_exact(words(spark, sf_dir, lang), norms(spark, sf_dir, lang))


def tagged(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    return structure.annotate_pos_lemma(words(spark, sf_dir, lang), tags(spark, sf_dir, lang))


def evidence(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Tokens with tag, lemma and scores by one join with the whole lexicon."""
    rows = structure.annotate_pos_lemma(words(spark, sf_dir, lang), lexicon(spark, sf_dir, lang).drop("listed"))
    return rows.withColumn("is_stopword", F.col("form").isin(STOPWORDS)).withColumn("is_content", F.col("tag").isin(*structure.CONTENT))


def form_counts(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """work_id, form, n of every word of a work, counted where its text is."""
    return plain_words(spark, sf_dir, lang).groupBy("work_id", "form").agg(F.count("*").alias("n"))


def line_counts(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """work_id, line_no, k: the number of words of each line that has one."""
    lines = structure.lines(by_work(works(spark, sf_dir, lang)))
    return lines.select("work_id", "line_no", F.size(F.regexp_extract_all("line", F.lit(LETTERS), 0)).alias("k")).filter("k > 0")


def placed(rows: DataFrame, table: DataFrame, *at: str, how: str = "left") -> DataFrame:
    """Tokens (work_id, form, and ``at``; dealt by work) with the table's columns of their form, dealt by work again: a form of a
    work travels once, with all of its places."""
    held = rows.groupBy("work_id", "form").agg(F.collect_list(F.struct(*at)).alias("at"))
    return by_work(held.join(table, "form", how)).select("work_id", *table.columns, F.inline("at"))


def form_evidence(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """``form_counts`` with tag, lemma and scores, and whether a form is a stopword or a content word."""
    rows = structure.annotate_pos_lemma(form_counts(spark, sf_dir, lang), lexicon(spark, sf_dir, lang).drop("listed"))
    return rows.withColumn("is_stopword", F.col("form").isin(STOPWORDS)).withColumn("is_content", F.col("tag").isin(*structure.CONTENT))


def work_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the scores, spread, matched and all tokens of each work, of its counted forms."""
    rows = form_counts(spark, sf_dir).join(norms(spark, sf_dir).select("form", "value", "arousal", "dominance"), "form", "left")
    n = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0).cast("bigint"))
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.nullif(n, F.lit(0))
    away = F.sum(F.col("value") * F.col("value") * F.col("n")) / F.nullif(n, F.lit(0)) - mean("value") * mean("value")
    sd = F.when(n > 0, F.sqrt(F.greatest(away, F.lit(0.0))))
    return rows.groupBy("work_id").agg(mean("value").alias("valence"), mean("arousal").alias("arousal"), mean("dominance").alias("dominance"), sd.alias("sd"), n.alias("n"), F.sum("n").alias("tokens"))


_LIST = ", ".join(f"'{t}'" for t in TAGS)
_SOME = ", ".join(f"CASE WHEN ('0x' || substr(md5(form), {20 + i}, 1))::INT < 4 THEN '{c}' END" for i, c in enumerate(CATEGORIES))
_STOP = ", ".join(f"'{s}'" for s in STOPWORDS)
_CUT = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"

PRELUDE = f"""
WITH wk AS (SELECT doc_id AS work_id, source AS poet, text FROM documents),
pt AS (SELECT work_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM (SELECT work_id, string_split_regex(text, {_CUT}) AS p FROM wk)),
ln AS (SELECT work_id, i AS line_no, p[i] AS line FROM (SELECT work_id, p, unnest(range(1, len(p) + 1)) AS i FROM pt)),
tk AS (SELECT work_id, line_no, j AS line_pos, ws[j] AS surface, lower(ws[j]) AS form FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM (SELECT *, regexp_extract_all(line, '\\p{{L}}+') AS ws FROM ln))),
t AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY line_no, line_pos) AS pos FROM tk),
vocab AS (SELECT DISTINCT form FROM t),
nm AS (SELECT form, ('0x' || substr(md5(form), 1, 4))::INT / 65535.0 AS value, ('0x' || substr(md5(form), 6, 4))::INT / 65535.0 AS arousal, ('0x' || substr(md5(form), 10, 4))::INT / 65535.0 AS dominance,
       [x for x in [{_SOME}] if x IS NOT NULL] AS categories FROM vocab WHERE ('0x' || substr(md5(form), 5, 1))::INT < 8),
tg AS (SELECT form, ([{_LIST}])[('0x' || substr(md5(form), 14, 1))::INT % 8 + 1] AS tag, regexp_replace(form, '(ing|ed|s)$', '') AS lemma FROM vocab),
m AS (SELECT t.*, nm.value, nm.arousal, nm.dominance, nm.categories FROM t LEFT JOIN nm USING (form)),
e AS (SELECT m.*, tg.tag, tg.lemma, m.form IN ({_STOP}) AS is_stopword, tg.tag IN ('NOUN', 'VERB', 'ADJ', 'ADV') AS is_content FROM m JOIN tg USING (form)),
wm AS (SELECT work_id, avg(value) AS valence, avg(arousal) AS arousal, avg(dominance) AS dominance, stddev_pop(value) AS sd, count(value) AS n, count(*) AS tokens FROM m GROUP BY work_id)
"""

#: The same for rules that hold for English alone.
ENGLISH = PRELUDE.replace("FROM documents)", "FROM documents WHERE lang = 'en')", 1)

STATS = """count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, CASE WHEN count(value) > 1 THEN round(stddev_pop(value), 6) END AS sd, round(min(value), 6) AS minimum,
CASE WHEN count(value) > 1 THEN round(quantile_cont(value, 0.25), 6) END AS q1, CASE WHEN count(value) > 1 THEN round(quantile_cont(value, 0.75), 6) END AS q3, round(max(value), 6) AS maximum"""
