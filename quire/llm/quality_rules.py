r"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each text is described in one narrow pass: words, symbols, repeated lines, words in repeated three-word
windows, and the hash and length of each normalised line (lower case, runs of digits as 0, white space
collapsed).  A line is boilerplate of a host (``source``) when it stands in at least ``min_docs`` of the
host's distinct documents and in more than ``max_share`` of them.  Documents of one host with the same
text are one document here, so that a page copied a thousand times doesn't make its own lines
boilerplate.  Boilerplate lines go; a document that loses more than ``max_loss`` of its words is
depleted and rejected, as is one that fails the base rules.

The shuffles carry line hashes, not texts.  Lines are counted with partial sums before the shuffle, so a
host with a third of all rows, or a line in all of them, reaches the reducers as one row a task.

Edge cases: a null or empty text has no words, fails the base rules and goes.  A null source is a host
of its own.  Repeated rows get the same verdict.  Extra columns are carried by ``clean_documents`` and
ignored by ``quality_report``.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_GAP, stored

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, WORD_GAP, " "))), "[0-9]+", "0")


def line_keys(text: Column) -> Column:
    """[{line hash, words}] of the lines that have a word."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(split_words(x)).alias("words")))


def windows(hashes: Column, n: Column) -> Column:
    """[{hash, place}] of all windows of WINDOW words, sorted, so that equal ones are neighbours."""
    starts = F.when(n >= WINDOW, F.slice(hashes, 1, n - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(F.transform(starts, lambda h, i: F.struct(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("g"), i.alias("p"))))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, source, print, base columns and lines of each row; one narrow pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "source", F.xxhash64(text).alias("print"), text.alias("t"))
    d = d.withColumn("w", F.transform(split_words(F.col("t")), lambda x: F.xxhash64(x))).withColumn("n", F.size("w"))
    d = d.withColumn("g", windows(F.col("w"), F.col("n")))
    twice = F.filter("g", lambda x, i: (F.get(F.col("g"), i - 1)["g"] == x["g"]) | (F.get(F.col("g"), i + 1)["g"] == x["g"]))
    d = d.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["p"])))
    # the union of the spans of windows found more than once
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
    )["n"]
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.withColumn("ls", lines)
    return d.select(
        "doc_id",
        "source",
        "print",
        F.col("n").cast("bigint").alias("n_words"),
        F.char_length(F.regexp_replace("t", WORD_GAP, "")).cast("bigint").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        line_keys(F.col("t")).alias("lines"),
    )


def boilerplate(described: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(source, line, n_docs) of lines above the limits."""
    pages = described.groupBy("source", "print").agg(F.first(F.array_distinct(F.col("lines.line"))).alias("lines"))
    totals = pages.groupBy("source").agg(F.count("*").alias("pages"))
    counts = pages.select("source", F.explode("lines").alias("line")).groupBy("source", "line").agg(F.count("*").alias("n_docs"))
    counts, totals = counts.filter(F.col("n_docs") >= min_docs).alias("c"), totals.hint("shuffle_merge").alias("t")
    return counts.join(totals, F.col("c.source").eqNullSafe(F.col("t.source"))).filter(F.col("n_docs") > max_share * F.col("pages")).select("c.source", "line", "n_docs")


def _judged(docs: DataFrame, min_docs: int, max_share: float) -> tuple[DataFrame, DataFrame]:
    described = stored(describe(docs), "quality")
    flagged = stored(boilerplate(described, min_docs, max_share), "boilerplate")  # read back: its true size picks the join
    each = described.select("doc_id", "source", "print", F.explode("lines").alias("l")).select("doc_id", "source", "print", F.col("l.line").alias("line"), F.col("l.words").alias("words"))
    f = flagged.select(F.col("source").alias("host"), F.col("line").alias("hit"))
    lost = each.join(f, F.col("source").eqNullSafe(F.col("host")) & (F.col("line") == F.col("hit")))
    lost = lost.groupBy("doc_id", "source", "print").agg(F.sum("words").alias("lost"), F.collect_set("line").alias("cut"))
    return described, lost


def quality_report(docs: DataFrame, min_docs: int = 20, max_share: float = 0.05, max_loss: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words."""
    described, lost = _judged(docs, min_docs, max_share)
    return _verdicts(described, lost, max_loss).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("lost_words").alias("n_lost_words"))


def _verdicts(described: DataFrame, lost: DataFrame, max_loss: float) -> DataFrame:
    """Rows that agree in id, source and text were summed up together; their number divides the sum."""
    copies = described.groupBy("doc_id", "source", "print").agg(F.count("*").alias("copies"))
    d, x = described.alias("d"), lost.alias("x")
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & F.col("d.source").eqNullSafe(F.col("x.source")) & (F.col("d.print") == F.col("x.print"))
    c = copies.alias("c")
    again = F.col("x.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("x.source").eqNullSafe(F.col("c.source")) & (F.col("x.print") == F.col("c.print"))
    x = x.join(c.hint("shuffle_merge"), again).select("x.doc_id", "x.source", "x.print", (F.col("lost") / F.col("copies")).cast("bigint").alias("lost"), "cut").alias("x")
    joined = d.join(x.hint("shuffle_merge"), same, "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    lost_words = F.coalesce("x.lost", F.lit(0)).cast("bigint")
    return joined.select("d.*", lost_words.alias("lost_words"), failed.alias("base_failed"), (~failed & (lost_words <= max_loss * F.col("n_words"))).alias("kept"), "x.cut")


def clean_documents(docs: DataFrame, min_docs: int = 20, max_share: float = 0.05, max_loss: float = 0.5) -> DataFrame:
    """Documents that pass, without their boilerplate lines; ``n_chars`` follows where it exists."""
    described, lost = _judged(docs, min_docs, max_share)
    ok = _verdicts(described, lost, max_loss).filter("kept").select("doc_id", "source", "print", "cut").dropDuplicates(["doc_id", "source", "print"]).alias("v")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & F.col("d.source").eqNullSafe(F.col("v.source")) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("v.print"))
    joined = d.join(ok.hint("shuffle_merge"), same)
    stay = F.filter(F.split("d.text", "\n"), lambda x: ~F.array_contains(F.col("v.cut"), F.xxhash64(normal_line(x))))
    text = F.when(F.col("v.cut").isNull(), F.col("d.text")).otherwise(F.array_join(stay, "\n"))
    columns = {c: F.col(f"d.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("v.cut").isNull(), columns["n_chars"]).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[c.alias(n) for n, c in columns.items()])


#: The same rows in DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS parts FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, line, regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS norm
      FROM (SELECT doc_id, source, t, unnest(parts) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
pages AS (SELECT source, count(DISTINCT t) AS pages FROM d GROUP BY source),
flagged AS (SELECT l.source, l.norm FROM l JOIN pages ON pages.source IS NOT DISTINCT FROM l.source GROUP BY l.source, l.norm, pages.pages
            HAVING count(DISTINCT l.t) >= 20 AND count(DISTINCT l.t) > 0.05 * pages.pages),
lost AS (SELECT l.doc_id, sum(len(regexp_extract_all(l.line, '[^\x20\x09-\x0D]+'))) AS n
         FROM l JOIN flagged f ON f.source IS NOT DISTINCT FROM l.source AND f.norm = l.norm GROUP BY l.doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= 0.5 * n_words AS kept, n_lost_words
FROM b
"""
