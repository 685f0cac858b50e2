"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of apostrophe, and the one they are written as.
APOSTROPHES = ("‘’ʼ＇", "''''")
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def ratio(numerator, denominator) -> Column:
    """Null where the denominator is 0: missing evidence stays missing."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (numerator, denominator))
    return n / F.nullif(d, F.lit(0))


def text_lines(text: Column) -> Column:
    """Physical lines; an empty last element, left by a final line end, is no line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normal_form(word: Column) -> Column:
    """Lower case, trimmed, one kind of apostrophe."""
    return F.translate(F.lower(F.trim(word)), *APOSTROPHES)


def strip_edges(word: Column) -> Column:
    return F.regexp_replace(word, "^\\p{P}+|\\p{P}+$", "")


def possessive_base(form: Column) -> Column:
    return F.when(form.endswith("'s"), form.substr(F.lit(1), F.length(form) - 2)).when(form.endswith("s'"), form.substr(F.lit(1), F.length(form) - 1))


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e, at least one."""
    groups = F.size(F.regexp_extract_all(word, F.lit("[aeiouy]+"), 0))
    silent = word.rlike("e$") & ~word.rlike("[^aeiouy]le$") & (groups > 1)
    return F.greatest(F.lit(1), groups - silent.cast("int"))


def summary(value: str | Column, prefix: str = "") -> list[Column]:
    """count, mean, median, sd, minimum, q1, q3, maximum; with one value no spread and no quartiles."""
    v = F.col(value) if isinstance(value, str) else value
    n = F.count(v)
    many = lambda x: F.when(n > 1, x)
    parts = {
        "count": n, "mean": F.avg(v), "median": F.percentile(v, F.lit(0.5)), "sd": many(F.stddev_pop(v)), "minimum": F.min(v),
        "q1": many(F.percentile(v, F.lit(0.25))), "q3": many(F.percentile(v, F.lit(0.75))), "maximum": F.max(v),
    }
    return [x.alias(prefix + k) for k, x in parts.items()]


def half_up(value: Column, digits: int = 6) -> Column:
    """A double of 0 or more to some places as its own bits have it, not the shortest decimal that names it: what stands a
    bit below a half goes down."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


def rounded(df, digits: int = 6):
    """Doubles to a fixed number of places, for comparison across engines."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
