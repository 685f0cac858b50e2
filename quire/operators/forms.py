"""Inherited forms: observations of a work as arrays, and graded scores of a form's rules over them.

A rule is data: its name, its kind, the kind's parameters, a weight, and whether the form requires it.  Each kind
compiles to column expressions over one row a work; no rule joins or shuffles.  A score is in 0-1, null where the
evidence is missing; coverage is the share of the evidence that a rule asks for and the work has.

Observations of a work, an item a line but for ``stanzas``: ``lines`` (its words), ``stanzas`` (lines of each),
``syllables`` and ``stresses`` (null where a word's are unknown), ``endings``, ``initials``, ``labels`` (what the last word
rhymes on, null where its pronunciations disagree or there is none), ``vowels`` (the last word's stressed vowel),
``alliteration``, ``qafias`` (what the words before the last one to four sound like), and ``credits``: pairs of lines (i < j,
from 1) that rhyme in part.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import syllables

# The lines that some forms repeat, the order of a sestina's end words, least scores of the classes.
REPEATS = {
    "villanelle_refrains": [(1, 6, 12, 18), (3, 9, 15, 19)], "glosa_refrains": [(1, 14), (2, 24), (3, 34), (4, 44)], "terzanelle_refrains": [(1, 6, 12), (3, 10, 18)],
    "rondeau_redouble_refrains": [(1, 8), (2, 12), (3, 16), (4, 20)], "bop_refrain": [(7, 16, 23)], "paradelle_repetition": [(1, 2), (3, 4), (7, 8), (9, 10), (13, 14), (15, 16)],
}
ROTATION = [0, 1, 2, 3, 4, 5, 5, 0, 4, 1, 3, 2, 2, 5, 3, 0, 1, 4, 4, 2, 1, 5, 0, 3, 3, 4, 0, 2, 5, 1, 1, 3, 5, 4, 2, 0]
CLASSES = [(0.95, "Strict"), (0.82, "Strongly conforming"), (0.68, "Modified"), (0.55, "Form-derived"), (0.45, "Suggestive resemblance")]
#: How much a form counts in the ranking, by how far its rules can be read off a text.
MODES = {"automatic": 1.0, "partial": 0.9, "manual": 0.5}
#: Least consistency and evidence of a suggestion; least consistency, evidence and margin of the two upper confidences.
SUGGESTED, EVIDENCE, MODERATE, HIGH = 0.45, 0.70, (0.58, 0.50, 0.03), (0.75, 0.75, 0.08)


class Rule(NamedTuple):
    name: str
    kind: str
    parameters: dict
    weight: float = 1.0
    required: bool = False


#: form -> its rules
Registry = dict[str, list[Rule]]


def observations(line_rows: DataFrame, sounds: DataFrame | None = None, pattern: str = "\\p{L}+") -> DataFrame:
    """One row a work.  ``line_rows``: work_id, line_no, stanza_no, line; lines without a word are left out.  ``sounds``:
    work_id, line_no, label, vowel, stresses, credits (array of (line_no, credit) with later lines), qafias (phones of the
    words before the last one to four); without it those are unknown."""
    rows = line_rows.select("work_id", "line_no", "stanza_no", F.transform(F.regexp_extract_all("line", F.lit(pattern), 0), lambda w: F.lower(w)).alias("ws")).filter(F.size("ws") > 0)
    if sounds is None:
        rows = rows.select("*", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("vowel"), F.lit(None).cast("int").alias("stresses"), F.lit(None).cast("array<struct<line_no:int,credit:double>>").alias("credits"), F.lit(None).cast("array<array<string>>").alias("qafias"))
    else:
        rows = rows.join(sounds.hint("shuffle_merge"), ["work_id", "line_no"], "left")
    held = rows.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "stanza_no", "ws", "label", "vowel", "stresses", "credits", "qafias"))).alias("l"))
    each = lambda f: F.transform("l", f)
    places = held.select("work_id", "l", F.array_distinct(each(lambda x: x["stanza_no"])).alias("numbers"), each(lambda x: x["line_no"]).alias("at"))
    place = lambda n: F.array_position("at", n).cast("int")
    credits = F.flatten(each(lambda x: F.transform(F.coalesce(x["credits"], F.array().cast("array<struct<line_no:int,credit:double>>")), lambda c: F.struct(place(x["line_no"]).alias("i"), place(c["line_no"]).alias("j"), c["credit"].alias("credit")))))
    sounds_of = lambda x: F.filter(F.transform(x["ws"], lambda w: F.regexp_extract(w, "^[b-df-hj-np-tv-z]", 0)), lambda c: c != "")
    repeated = lambda s: F.size(F.filter(s, lambda c: F.size(F.filter(s, lambda d: c == d)) > 1))
    return places.select(
        "work_id", each(lambda x: x["ws"]).alias("lines"), F.transform("numbers", lambda s: F.size(F.filter("l", lambda x: x["stanza_no"] == s))).alias("stanzas"),
        each(lambda x: F.aggregate(x["ws"], F.lit(0), lambda t, w: t + syllables(w))).alias("syllables"), each(lambda x: x["stresses"]).alias("stresses"), each(lambda x: F.element_at(x["ws"], -1)).alias("endings"),
        each(lambda x: F.nullif(F.regexp_extract(F.array_join(x["ws"], " "), "[a-z]", 0), F.lit(""))).alias("initials"), each(lambda x: x["label"]).alias("labels"), each(lambda x: x["vowel"]).alias("vowels"),
        each(lambda x: repeated(sounds_of(x)) / F.nullif(F.size(sounds_of(x)), F.lit(0))).alias("alliteration"), credits.alias("credits"), each(lambda x: x["qafias"]).alias("qafias"),
    )


# --- measures ---------------------------------------------------------------------------------------

Score = tuple[Column, Column]


def n_lines() -> Column:
    return F.size("lines")


def n_stanzas() -> Column:
    return F.size("stanzas")


def _one() -> Column:
    return F.lit(1.0)


def _none() -> Column:
    return F.lit(0.0)


def _let(x: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _unit(x: Column) -> Column:
    """In 0-1; null stays null."""
    return _let(x, lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, _none()), _one())))


def _over(x, n) -> Column:
    return x / F.nullif(n, F.lit(0))


def _known(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def _sum(items: Column) -> Column:
    return F.aggregate(items, _none(), lambda t, x: t + x)


def _mean(items: Column) -> Column:
    """Of an array without nulls; null if it is empty."""
    return _let(items, lambda v: _over(_sum(v), F.size(v)))


def _first(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def _ints(values) -> Column:
    return F.expr(f"array({', '.join(str(int(v)) for v in values)})")


def nearness(n: Column, expected) -> Column:
    """How near a count is to the one expected: a quarter of it off, or two of a small one, is nothing."""
    expected = F.lit(float(expected)) if not isinstance(expected, Column) else expected
    return _unit(1 - F.abs(n - expected) / F.greatest(F.lit(2.0), expected * 0.25))


def inside(x: Column, low: float, high: float) -> Column:
    """1 in the range, less outside it by the half of its width, two at least."""
    return _unit(1 - F.greatest(low - x, x - high, _none()) / max(2.0, (high - low + 1) * 0.5))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance in words / longer line.  Each distinct word of the two lines counts as a character."""

    def differ(p):
        coded = lambda words, x: F.array_join(F.transform(x, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, w) + 20_000), 8, "0")), "UTF-32")), "")
        away = _let(F.array_distinct(F.concat(p["a"], p["b"])), lambda words: F.levenshtein(coded(words, p["a"]), coded(words, p["b"])))
        return F.when((F.size(p["a"]) == 0) | (F.size(p["b"]) == 0), 0.0).when(p["a"] == p["b"], 1.0).otherwise(1 - away / F.greatest(F.size(p["a"]), F.size(p["b"])))

    return _let(F.struct(a.alias("a"), b.alias("b")), differ)


def _line(i: Column) -> Column:
    return F.get("lines", i - 1)


def _pair(i, j) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))


def _literal(pairs) -> Column:
    """Pairs of line numbers, from 1, as one expression."""
    return F.expr(f"cast(array({', '.join(f'named_struct("i", {i}, "j", {j})' for i, j in pairs)}) AS array<struct<i:int,j:int>>)")


def _pairs(groups) -> Column:
    """Each group's first line with its others."""
    return _literal([(g[0], x) for g in groups for x in g[1:]])


def repeated(pairs: Column) -> Score:
    there = F.filter(pairs, lambda p: n_lines() >= F.greatest(p["i"], p["j"]))
    return _mean(F.transform(there, lambda p: similarity(_line(p["i"]), _line(p["j"])))), F.coalesce(_over(F.size(there), F.size(pairs)), _none())


def followed(values: Column, targets: Column, tolerance: float, whole: Column) -> Score:
    """How near known values are to their targets, and the known share of ``whole``."""
    both = F.filter(F.arrays_zip(values.alias("x"), targets.alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return _mean(F.transform(both, lambda p: _unit(1 - F.abs(p["x"] - p["y"]) / tolerance))), F.size(both) / F.greatest(whole, F.lit(1))


def _cycled(counts) -> Column:
    return F.transform(_first(n_lines()), lambda i: F.get(_ints(counts), (i % len(counts)).cast("int")))


def _best(options: list[Score]) -> Score:
    """The option with the highest score."""
    known = F.filter(F.array(*[F.struct(s.alias("s"), c.alias("c")) for s, c in options]), lambda x: x["s"].isNotNull())
    top = F.get(F.sort_array(known, asc=False), F.lit(0))
    return top["s"], F.coalesce(top["c"], _none())


def _each(values: str, test) -> Score:
    """Mean of a score over the known values of the lines."""
    known = _known(F.col(values))
    return _mean(F.transform(known, test)), F.coalesce(_over(F.size(known), n_lines()), _none())


def _whole(score) -> Score:
    """Of the syllables of all lines, where all are known."""
    known = _known(F.col("syllables"))
    complete = (F.size(known) == n_lines()) & (n_lines() > 0)
    return F.when(complete, score(_sum(known))), F.when(complete, _one()).otherwise(F.coalesce(_over(F.size(known), n_lines()), _none()))


def _spread(score) -> Score:
    """Of the variation of the lines' syllables: three known ones at least."""
    known = _known(F.col("syllables"))
    mean = _mean(known)
    sd = F.sqrt(_mean(F.transform(known, lambda x: (x - mean) * (x - mean))))
    return F.when((F.size(known) >= 3) & (mean > 0), score(sd / mean)), F.coalesce(_over(F.size(known), n_lines()), _none())


def credit(i: Column, j: Column) -> Column:
    """How far two lines (from 1, i < j) rhyme: null unless both ends are known."""
    a, b = F.get("labels", i - 1), F.get("labels", j - 1)
    part = F.get(F.filter("credits", lambda c: (c["i"] == i) & (c["j"] == j)), F.lit(0))["credit"]
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1.0).otherwise(F.coalesce(part, _none())))


def schemed(pairs: Column, length: Column) -> Score:
    """Lines that should rhyme (``pairs``, of the first ``length`` lines) and all others, which shouldn't, averaged apart and then
    together.  Only pairs that should rhyme are looked at one by one; the others are counted."""
    length = F.least(length, n_lines())
    within = F.filter(pairs, lambda p: p["j"] <= length)
    label = lambda i: F.get("labels", i - 1)
    half = lambda n: n * (n - 1) / 2
    known = _known(F.slice("labels", F.lit(1), F.greatest(length, F.lit(0))))
    size = lambda v: F.size(v).cast("double")

    def no(v):
        """The share of pairs that shouldn't rhyme and don't."""
        alike = _sum(F.transform(F.array_distinct(v), lambda x: half(_count(v, lambda y: y == x).cast("double"))))
        return 1 - _over(alike - _count(within, lambda p: label(p["i"]) == label(p["j"])), half(size(v)) - _count(within, lambda p: label(p["i"]).isNotNull() & label(p["j"]).isNotNull()))

    parts = F.struct(_mean(_known(F.transform(within, lambda p: credit(p["i"], p["j"])))).alias("yes"), _let(known, no).alias("no"))
    score = _let(parts, lambda x: F.coalesce((x["yes"] + x["no"]) / 2, x["yes"], x["no"]))
    return score, F.coalesce(_over(_let(known, lambda v: half(size(v))), half(length.cast("double"))), _none())


def _same(letters: str) -> list[tuple[int, int]]:
    return [(i + 1, j + 1) for i in range(len(letters)) for j in range(i + 1, len(letters)) if letters[i] == letters[j]]


def _blocks(pairs: list[tuple[int, int]], size: int) -> Column:
    """Pairs of lines, repeated for every block of so many lines."""
    return F.flatten(F.transform(_first(F.ceil(n_lines() / size)), lambda b: F.transform(_literal(pairs), lambda p: _pair(p["i"] + b * size, p["j"] + b * size))))


def _relations(pairs: Column) -> Score:
    known = lambda i: F.get("labels", i - 1).isNotNull()
    return _mean(_known(F.transform(pairs, lambda p: credit(p["i"], p["j"])))), F.coalesce(_over(_count(pairs, lambda p: known(p["i"]) & known(p["j"])), F.size(pairs)), _none())


def _starts() -> Column:
    """Lines before each stanza."""
    return F.transform(_first(n_stanzas()), lambda k: _sum(F.slice("stanzas", F.lit(1), k)).cast("int"))


def _top(values: Column) -> Column:
    """How often the commonest value stands there."""
    return _let(values, lambda v: F.array_max(F.transform(F.array_distinct(v), lambda x: _count(v, lambda y: y == x))))


# --- kinds of rules -----------------------------------------------------------------------------------

KINDS: dict[str, tuple[str, Callable[..., Score]]] = {}


def kind(family: str, *names: str):
    def keep(f):
        for name in names or [f.__name__]:
            KINDS[name] = family, f
        return f

    return keep


kind("counts", "line_count_exact")(lambda count: (nearness(n_lines(), count), _one()))
kind("counts", "line_count_range")(lambda minimum, maximum: (inside(n_lines(), minimum, maximum), _one()))
kind("counts", "word_count_pattern")(lambda counts: followed(F.transform("lines", lambda x: F.size(x)), _ints(counts), 2.0, F.lit(len(counts))))
kind("counts", "maximum_word_length")(lambda maximum: (_over(_count(F.flatten("lines"), lambda w: F.length(w) <= maximum), F.size(F.flatten("lines"))), _one()))
kind("counts", "total_syllable_range")(lambda minimum, maximum: _whole(lambda t: inside(t, minimum, maximum)))
kind("counts", "maximum_total_syllables")(lambda maximum: _whole(lambda t: _unit(1 - F.greatest(t - maximum, _none()) / maximum)))
kind("counts", "syllable_range")(lambda minimum, maximum: _each("syllables", lambda x: inside(x, minimum, maximum)))
kind("counts", "stress_count_range")(lambda minimum, maximum: _each("stresses", lambda x: inside(x, minimum, maximum)))


@kind("stanzas")
def stanza_pattern(patterns) -> Score:
    def fit(expected):
        differ = _sum(F.transform(F.arrays_zip(F.col("stanzas").alias("x"), _ints(expected).alias("y")), lambda p: F.abs(F.coalesce(p["x"], F.lit(0)) - F.coalesce(p["y"], F.lit(0)))))
        near = (nearness(n_stanzas(), len(expected)) + _unit(1 - differ / max(sum(expected), 1))) / 2
        return F.when(F.col("stanzas") == _ints(expected), 1.0).when(n_stanzas() == 0, 0.0).otherwise(near)

    return F.array_max(F.array(*map(fit, patterns))), _one()


@kind("stanzas")
def uniform_stanza_size(size, minimum=1) -> Score:
    n = _count(F.col("stanzas"), lambda s: s == size)
    return _over(n, n_stanzas()) * F.least(_one(), n / minimum), _one()


@kind("stanzas")
def alternating_stanza_sizes(sizes) -> Score:
    return _mean(F.transform("stanzas", lambda s, k: nearness(s, F.get(_ints(sizes), (k % len(sizes)).cast("int")).cast("double")))), _one()


@kind("stanzas")
def quatrain_sequence(minimum) -> Score:
    n = _count(F.col("stanzas"), lambda s: s == 4)
    return F.least(_one(), n / minimum) * _over(n, n_stanzas()), _one()


@kind("stanzas")
def terza_stanzas() -> Score:
    last = F.element_at("stanzas", -1)
    core = F.when(last.isin(1, 2), F.slice("stanzas", F.lit(1), n_stanzas() - 1)).otherwise(F.col("stanzas"))
    score = _count(core, lambda s: s == 3) / F.greatest(F.size(core), F.lit(1)) * F.when(last.isin(1, 2, 3), 1.0).otherwise(0.8)
    return F.when(n_stanzas() > 0, score), _one()


@kind("stanzas")
def ghazal_architecture(minimum, maximum) -> Score:
    n = _count(F.col("stanzas"), lambda s: s == 2)
    ranged = F.when((n >= minimum) & (n <= maximum), 1.0).otherwise(_unit(1 - F.least(F.abs(n - minimum), F.abs(n - maximum)) / minimum))
    return (_over(n, n_stanzas()) + ranged) / 2, _one()


@kind("stanzas")
def chanso_architecture() -> Score:
    body = F.slice("stanzas", F.lit(1), n_stanzas() - 1)
    size = F.bround(_mean(body))
    fits = (_over(_count(body, lambda s: s == size), F.size(body)), nearness(F.element_at("stanzas", -1), F.greatest(_one(), F.bround(size / 2))), F.greatest(nearness(F.size(body), 5), nearness(F.size(body), 6)))
    return F.when(n_stanzas() >= 6, reduce(lambda a, b: a + b, fits) / 3), _one()


kind("lines", "syllable_pattern")(lambda counts: followed(F.col("syllables"), _ints(counts), 3.0, F.lit(len(counts))))
kind("lines", "syllable_pattern_repeating")(lambda counts: followed(F.col("syllables"), _cycled(counts), 3.0, n_lines()))
kind("lines", "syllable_pattern_alternatives")(lambda patterns: _best([followed(F.col("syllables"), _ints(p), 3.0, F.lit(len(p))) for p in patterns]))
kind("lines", "choka_syllable_pattern")(lambda: followed(F.col("syllables"), F.transform(_first(n_lines()), lambda i: F.when((i % 2 == 1) | (i == n_lines() - 1), 7).otherwise(5)), 3.0, n_lines()))
kind("lines", "stress_count_pattern_repeating")(lambda counts: followed(F.col("stresses"), _cycled(counts), 2.0, n_lines()))
kind("lines", "line_length_uniformity")(lambda: _spread(lambda cv: _unit(1 - cv / 0.35)))
kind("lines", "line_length_variation")(lambda minimum_cv: _spread(lambda cv: _unit(cv / max(minimum_cv, 0.01))))


def _contrast(long: Column, short: Column) -> Column:
    """How much longer some lines are than others, where all are known and there are some of both."""
    complete = ~F.exists(F.concat(long, short), lambda x: x.isNull()) & (F.size(long) > 0) & (F.size(short) > 0)
    return F.when(complete, _unit((_mean(long) - _mean(short) + 1) / 3))


def _contrasts(found: Column) -> Score:
    known = _known(found)
    return _mean(known), F.coalesce(_over(F.size(known), F.size(found)), _none())


@kind("lines")
def terminal_line_longer(period) -> Score:
    ends = _first(F.floor(n_lines() / period))
    return _contrasts(F.transform(ends, lambda b: _contrast(F.slice("syllables", b * period + period, F.lit(1)), F.slice("syllables", b * period + 1, F.lit(period - 1)))))


@kind("lines")
def periodic_line_length_relation(period, long_positions, short_positions) -> Score:
    at = lambda b, places: F.transform(F.filter(_ints(places), lambda p: b * period + p <= n_lines()), lambda p: F.get("syllables", b * period + p - 1))
    return _contrasts(F.transform(_first(F.ceil(n_lines() / period)), lambda b: _contrast(at(b, long_positions), at(b, short_positions))))


@kind("lines")
def terminal_line_shorter() -> Score:
    last, before = F.element_at("syllables", -1), _known(F.slice("syllables", F.lit(1), F.greatest(n_lines() - 1, F.lit(0))))
    enough = (n_lines() >= 3) & last.isNotNull()
    coverage = F.when(enough, F.when(F.size(before) > 0, (F.size(before) + 1) / n_lines()).otherwise(1.0)).otherwise(F.coalesce(_over(F.size(_known(F.col("syllables"))), n_lines()), _none()))
    return F.when(enough & (F.size(before) > 0), _unit((_mean(before) - last + 1) / 3)), coverage


@kind("lines")
def limerick_length_relation() -> Score:
    five = F.slice("syllables", 1, 5)
    mean = lambda *places: reduce(lambda a, b: a + b, [F.get("syllables", F.lit(p - 1)) for p in places]) / len(places)
    long, short = mean(1, 2, 5), mean(3, 4)
    complete = F.size(_known(five)) == 5
    return F.when(complete, _unit((long - short + 1) / F.greatest(long * 0.35, _one()))), F.when(complete, _one()).otherwise(F.size(_known(five)) / 5)


@kind("lines")
def alphabetic_line_initials() -> Score:
    hits = _known(F.transform(F.slice("initials", 1, 26), lambda c, i: F.when(c.isNotNull(), (F.ascii(c) == i + 97).cast("double"))))
    return _mean(hits), F.coalesce(_over(F.size(hits), F.least(n_lines(), F.lit(26))), _none())


kind("rhyme", "rhyme_scheme")(lambda schemes: _best([schemed(_literal(_same(s)), F.lit(len(s))) for s in (s.replace(" ", "") for s in schemes)]))
kind("rhyme", "rhyme_scheme_repeating")(lambda scheme: schemed(_blocks(_same(scheme.replace(" ", "")), len(scheme.replace(" ", ""))), n_lines()))
#: Lines 1 and 3 of a tercet, and the middle one with both of the next; 1, 2 and 4 of a quatrain, and the third with those of the next.
kind("rhyme", "terza_rhyme")(lambda: tuple(F.when(n_lines() >= 6, x).otherwise(other) for x, other in zip(schemed(_blocks([(1, 3), (2, 4), (2, 6)], 3), F.floor(n_lines() / 3).cast("int") * 3), (F.lit(None).cast("double"), _none()))))
kind("rhyme", "rubaiyat_chain")(lambda: schemed(_blocks([(1, 2), (1, 4), (2, 4), (3, 5), (3, 6), (3, 8)], 4), n_lines()))
kind("rhyme", "rhyme_couplets")(lambda: _relations(F.transform(_first(F.floor(n_lines() / 2)), lambda k: _pair(2 * k + 1, 2 * k + 2))))
kind("rhyme", "terminal_rhyming_couplet")(lambda: _relations(F.when(n_lines() > 1, F.array(_pair(n_lines() - 1, n_lines()))).otherwise(_literal([]))))
kind("rhyme", "terminal_pair_rhyme")(lambda positions: _relations(_pairs([sorted(positions)])))


@kind("rhyme")
def rhyme_absence(maximum_density) -> Score:
    known = _known(F.col("labels"))
    density = _over(_count(known, lambda x: _count(known, lambda y: x == y) > 1), F.size(known))
    score = _unit(1 - F.greatest(density - maximum_density, _none()) / max(1 - maximum_density, 0.01))
    return F.when(F.size(known) > 0, score), F.when(F.size(known) > 0, _one()).otherwise(0.0)


@kind("rhyme")
def monorhyme() -> Score:
    known = _known(F.col("labels"))
    return _over(_top(known), F.size(known)), F.coalesce(_over(F.size(known), n_lines()), _none())


@kind("rhyme")
def rhyme_class_count(count) -> Score:
    known = _known(F.col("labels"))
    return F.when(F.size(known) > 0, nearness(F.size(F.array_distinct(known)), count)), F.coalesce(_over(F.size(known), n_lines()), _none())


@kind("rhyme", "even_line_assonance", "seguidilla_assonance")
def even_line_assonance() -> Score:
    known = _known(F.filter("vowels", lambda v, i: i % 2 == 1))
    return _over(_top(known), F.size(known)), F.size(known) / F.greatest(F.floor(n_lines() / 2), F.lit(1))


for _name, _groups in REPEATS.items():
    kind("repetition", _name)(lambda groups=_groups: repeated(_pairs(groups)))
kind("repetition", "line_repetition_groups")(lambda groups: repeated(_pairs(groups)))
kind("repetition", "first_last_line_echo")(lambda: repeated(F.array(_pair(F.lit(1), n_lines()))))
kind("repetition", "duplex_echo")(lambda: repeated(F.transform(_first(F.floor((n_lines() - 1) / 2)), lambda k: _pair(2 * k + 2, 2 * k + 3))))
kind("repetition", "rondel_refrains")(lambda: repeated(F.when(n_lines() >= 14, _pairs([(1, 7, 13), (2, 8, 14)])).otherwise(_pairs([(1, 7, 13), (2, 8)]))))
kind("repetition", "sonnet_crown_links")(lambda sonnet_count: repeated(_pairs([(14 * k, 14 * k + 1) for k in range(1, sonnet_count - 1)])))
kind("repetition", "stanza_refrain")(lambda: repeated(F.transform(_first(n_stanzas() - 1), lambda k: _pair(F.get("stanzas", F.lit(0)), F.get(_starts(), k + 1) + F.get("stanzas", k + 1)))))


@kind("repetition")
def pantoum_repetition() -> Score:
    linked = lambda k: (F.get("stanzas", k) >= 4) & (F.get("stanzas", k + 1) >= 3)
    at = lambda k, line: F.get(_starts(), k) + line
    pairs = F.flatten(F.transform(F.filter(_first(n_stanzas() - 1), linked), lambda k: F.array(_pair(at(k, 2), at(k + 1, 1)), _pair(at(k, 4), at(k + 1, 3)))))
    return repeated(pairs)[0], F.size(pairs) / F.greatest(2 * (n_stanzas() - 1), F.lit(1))


@kind("repetition")
def pantoum_closure() -> Score:
    last = F.element_at(_starts(), -1)
    closes = lambda a, b: (similarity(_line(F.lit(1)), _line(last + a)) + similarity(_line(F.lit(3)), _line(last + b))) / 2
    possible = (n_stanzas() >= 2) & (F.get("stanzas", F.lit(0)) >= 3) & (F.element_at("stanzas", -1) >= 4)
    return F.when(possible, F.greatest(closes(4, 2), closes(2, 4))), _one()


@kind("repetition")
def blues_repetition() -> Score:
    threes = F.filter(_first(n_stanzas()), lambda k: F.get("stanzas", k) == 3)
    starts = F.when(F.size(threes) > 0, F.transform(threes, lambda k: F.get(_starts(), k))).otherwise(F.transform(_first(F.floor(n_lines() / 3)), lambda k: (3 * k).cast("int")))
    return repeated(F.transform(starts, lambda s: _pair(s + 1, s + 2)))


@kind("repetition")
def partial_refrain_positions(anchor, positions) -> Score:
    opening = _line(F.lit(anchor))

    def at(p):
        size = F.least(F.size(opening), F.size(_line(p)), F.lit(5))
        return F.when((n_lines() >= anchor) & (n_lines() >= p), F.greatest(similarity(opening, _line(p)), similarity(F.slice(opening, F.lit(1), size), F.slice(_line(p), F.lit(1), size))))

    found = _known(F.transform(_ints(positions), at))
    return _mean(found), F.size(found) / len(positions)


@kind("rotation")
def sestina_rotation() -> Score:
    places = F.filter(_first(F.lit(len(ROTATION))), lambda i: i < n_lines())
    hits = F.transform(places, lambda i: (F.get("endings", i) == F.get("endings", F.get(_ints(ROTATION), i))).cast("double"))
    return F.when(n_lines() >= 6, _mean(hits)), F.when(n_lines() >= 6, F.size(hits) / len(ROTATION)).otherwise(0.0)


@kind("rotation")
def sestina_envoi() -> Score:
    seed, word = F.array_distinct(F.slice("endings", 1, 6)), lambda i: F.get("endings", F.lit(i))
    ends = lambda order: sum((word(36 + k) == word(s)).cast("double") for k, s in enumerate(order)) / 3
    back = F.size(F.array_intersect(seed, F.flatten(F.slice("lines", 37, 3)))) / F.size(seed)
    return F.when(n_lines() >= 39, (F.greatest(ends((4, 2, 0)), ends((0, 2, 4))) + back) / 2), F.when(n_lines() >= 39, _one()).otherwise(_unit((n_lines() - 36) / 3))


@kind("radif")
def ghazal_radif_qafia() -> Score:
    """The best supported last words of lines 1, 2, 4, 6, ..., one to four of them, and how far what stands before them sounds
    alike.  ``qafias``: of each line, by the number of its last words left out, the phones from the last stressed vowel on."""
    at = F.filter(_first(n_lines()), lambda i: (i < 2) | (i % 2 == 1))
    tail = lambda x, n: F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))
    first = F.get("lines", F.lit(0))
    holds = lambda i, n: (F.size(F.get("lines", i)) >= n) & (tail(F.get("lines", i), n) == tail(first, n))
    supports = F.transform(F.filter(_ints([1, 2, 3, 4]), lambda n: n <= F.size(first)), lambda n: F.struct((_count(at, lambda i: holds(i, n)) / F.size(at) + 0.01 * n).alias("s"), (-n).alias("less")))
    best = F.get(F.sort_array(supports, asc=False), F.lit(0))

    def found(b):
        n = -b["less"]
        support = F.round(b["s"] - 0.01 * n, 12)
        rimes = _known(F.transform(F.filter(at, lambda i: holds(i, n) & (F.size(F.get("lines", i)) > n)), lambda i: F.get(F.get("qafias", i), n - 1)))
        return F.struct(support.alias("support"), rimes.alias("rimes"))

    def score(x):
        anchor = F.get(x["rimes"], F.lit(0))
        alike = _mean(F.transform(F.slice(x["rimes"], F.lit(2), F.greatest(F.size(x["rimes"]) - 1, F.lit(0))), lambda r: F.when(r == anchor, 1.0).otherwise(similarity(anchor, r) * 0.6)))
        return F.when((x["support"] >= 0.5) & (F.size(x["rimes"]) >= 2), 0.65 * x["support"] + 0.35 * alike).otherwise(x["support"])

    coverage = lambda x: F.when(x["support"] < 0.5, 1.0).otherwise(0.65 + 0.35 * F.size(x["rimes"]) / F.size(at))
    enough, both = F.size(at) >= 4, lambda f: _let(_let(best, found), f)
    return F.when(enough, both(score)), F.when(enough, both(coverage)).otherwise(F.size(at) / 6)


@kind("sound")
def alliteration_density(minimum) -> Score:
    known = _known(F.col("alliteration"))
    return _unit(_mean(known) / max(minimum, 0.01)), F.coalesce(_over(F.size(known), n_lines()), _none())


kind("manual", "manual_requirement")(lambda: (F.lit(None).cast("double"), _none()))


def check_registry(registry: Registry) -> None:
    """Every rule's kind is known and takes its parameters."""
    for form, rules in registry.items():
        for rule in rules:
            if rule.kind not in KINDS:
                raise ValueError(f"{form}: no rule of kind {rule.kind}")
            KINDS[rule.kind][1](**rule.parameters)


def score_rules(obs: DataFrame, registry: Registry, families: list[str] | None = None) -> DataFrame:
    """(work_id, form, rule, weight, required, score, coverage) of the rules of the given families."""
    items = []
    for form, rules in registry.items():
        for rule in rules:
            family, make = KINDS[rule.kind]
            if families is None or family in families:
                score, coverage = make(**rule.parameters)
                items.append(F.struct(F.lit(form).alias("form"), F.lit(rule.name).alias("rule"), F.lit(rule.weight).alias("weight"), F.lit(rule.required).alias("required"), _unit(score.cast("double")).alias("score"), F.coalesce(_unit(coverage.cast("double")), _none()).alias("coverage")))
    return obs.select("work_id", F.explode(F.array(*items)).alias("r")).select("work_id", "r.*").withColumn("score", F.when(F.col("coverage").isNotNull(), F.col("score")))


def candidates(scores: DataFrame, modes: dict[str, str] | None = None) -> DataFrame:
    """Per work and form: consistency (scores weighted by weight and coverage), agreement and evidence of required rules,
    contradictions, evidence coverage, class, rank, margin to the next that can be read off a text, whether it is suggested,
    and a confidence by rule.  ``modes``: form -> automatic, partial or manual; automatic where none is named."""
    some = F.when(F.col("score").isNotNull(), F.col("weight") * F.col("coverage"))
    required = F.when(F.col("required"), some)
    found = scores.groupBy("work_id", "form").agg(
        (F.sum(some * F.col("score")) / F.nullif(F.sum(some), F.lit(0.0))).alias("consistency"), (F.sum(required * F.col("score")) / F.nullif(F.sum(required), F.lit(0.0))).alias("agreement"),
        F.count_if(F.col("required") & (F.col("score") < 0.2)).alias("contradictions"), (F.coalesce(F.sum(some), F.lit(0.0)) / F.sum("weight")).alias("evidence"),
        F.coalesce(F.coalesce(F.sum(required), F.lit(0.0)) / F.nullif(F.sum(F.when(F.col("required"), F.col("weight"))), F.lit(0.0)), F.lit(1.0)).alias("required_evidence"),
    )
    mode = reduce(lambda c, m: c.when(F.col("form") == m[0], m[1]), (modes or {}).items(), F.when(F.lit(False), "")).otherwise("automatic")
    factor = reduce(lambda c, m: c.when(F.col("mode") == m[0], m[1]), MODES.items(), F.when(F.lit(False), 0.0))
    c = F.col("consistency")
    strict = (c >= 0.95) & (F.col("agreement").isNull() | (F.col("agreement") >= 0.95))
    label = F.when(c.isNull(), "No match").when(strict, "Strict")
    for least, name in CLASSES[1:]:
        label = label.when(c >= least, name)
    rank = F.when(c.isNull(), -1.0).otherwise(F.round(c * F.col("evidence") * factor, 9))
    order = Window.partitionBy("work_id").orderBy(F.desc("k"), F.desc(F.round(F.coalesce("consistency", F.lit(-1.0)), 9)), "form")
    rows = found.withColumn("class", label.otherwise("No match")).withColumn("mode", mode).withColumn("k", rank)
    read = F.when((F.col("mode") != "manual") & c.isNotNull(), F.col("k"))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("next", F.first(read, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.withColumn("margin", F.when(c.isNotNull(), F.col("k") - F.col("next")))
    suggested = (F.col("mode") != "manual") & (c >= SUGGESTED) & (F.col("evidence") >= EVIDENCE) & (F.col("required_evidence") >= EVIDENCE) & (F.col("contradictions") == 0)
    rows = rows.withColumn("suggested", F.coalesce(suggested, F.lit(False)))
    clear = lambda least, evidence, margin: F.col("suggested") & (c >= least) & (F.col("evidence") >= evidence) & (F.coalesce(F.round("margin", 9), _none()) >= margin)
    rows = rows.withColumn("confidence", F.when(clear(*HIGH), "high").when(clear(*MODERATE), "moderate").otherwise("low"))
    shown = F.when(F.col("mode") == "manual", "Manual confirmation required").when(F.col("suggested"), F.col("class")).otherwise("No match")
    return rows.withColumn("classification", shown).drop("k", "next")
