"""Queries of inherited forms over the conversations (a turn is a stanza), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forms, phonology
from ..operators.forms import Rule
from ..sources.tables import kept, written
from . import base
from .queries import _CONVERSATION, _SYLLABLES, _conversation_lines, _query
from .sound_queries import _ENDING, _PAIRS, _PRON, _endings, _family, pronunciations

SONNETS = ["ABAB CDCD EFEF GG", "ABBA ABBA CDE CDE"]
#: form -> its rules; every kind of rule stands in one at least.
REGISTRY: forms.Registry = {
    "sonnet": [Rule("lines", "line_count_exact", {"count": 14}, 3.0, True), Rule("rhyme", "rhyme_scheme", {"schemes": SONNETS}, 2.0, True), Rule("syllables", "total_syllable_range", {"minimum": 120, "maximum": 160})],
    "haiku": [Rule("lines", "line_count_exact", {"count": 3}, 2.0, True), Rule("pattern", "syllable_pattern", {"counts": [5, 7, 5]}, 3.0, True), Rule("brevity", "maximum_total_syllables", {"maximum": 20})],
    "limerick": [Rule("lines", "line_count_exact", {"count": 5}, 2.0, True), Rule("rhyme", "rhyme_scheme", {"schemes": ["AABBA"]}, 3.0, True), Rule("lengths", "limerick_length_relation", {})],
    "couplets": [Rule("stanzas", "uniform_stanza_size", {"size": 2}, 2.0, True), Rule("rhyme", "rhyme_couplets", {}, 2.0), Rule("close", "terminal_rhyming_couplet", {})],
    "quatrains": [Rule("stanzas", "uniform_stanza_size", {"size": 4, "minimum": 2}, 2.0, True), Rule("pattern", "stanza_pattern", {"patterns": [[4, 4, 4, 4], [4, 4, 4]]})],
    "villanelle": [Rule("lines", "line_count_exact", {"count": 19}, 2.0, True), Rule("refrains", "villanelle_refrains", {}, 3.0, True), Rule("rhymes", "rhyme_class_count", {"count": 2})],
    "sestina": [Rule("lines", "line_count_exact", {"count": 39}), Rule("rotation", "sestina_rotation", {}, 3.0, True), Rule("envoi", "sestina_envoi", {}), Rule("stanzas", "stanza_pattern", {"patterns": [[6, 6, 6, 6, 6, 6, 3]]})],
    "pantoum": [Rule("quatrains", "quatrain_sequence", {"minimum": 3}, 2.0, True), Rule("repetition", "pantoum_repetition", {}, 3.0, True), Rule("closure", "pantoum_closure", {})],
    "terza rima": [Rule("tercets", "terza_stanzas", {}, 2.0), Rule("rhyme", "terza_rhyme", {}, 3.0, True), Rule("lengths", "line_length_uniformity", {})],
    "ghazal": [Rule("couplets", "ghazal_architecture", {"minimum": 5, "maximum": 15}, 2.0, True), Rule("radif", "ghazal_radif_qafia", {}, 3.0, True)],
    "rubai": [Rule("chain", "rubaiyat_chain", {}, 3.0, True), Rule("quatrains", "quatrain_sequence", {"minimum": 1})],
    "blues": [Rule("repetition", "blues_repetition", {}, 3.0, True), Rule("lines", "line_count_range", {"minimum": 3, "maximum": 36})],
    "glosa": [Rule("refrains", "glosa_refrains", {}, 3.0, True)],
    "rondel": [Rule("refrains", "rondel_refrains", {}, 3.0, True), Rule("rhyme", "terminal_pair_rhyme", {"positions": [1, 8]})],
    "rondeau": [Rule("rentrement", "partial_refrain_positions", {"anchor": 1, "positions": [9, 15]}, 3.0, True)],
    "triolet": [Rule("refrains", "line_repetition_groups", {"groups": [[1, 4, 7], [2, 8]]}, 3.0, True)],
    "terzanelle": [Rule("refrains", "terzanelle_refrains", {}, 3.0, True)],
    "rondeau redouble": [Rule("refrains", "rondeau_redouble_refrains", {}, 3.0, True)],
    "paradelle": [Rule("repetition", "paradelle_repetition", {}, 3.0, True)],
    "bop": [Rule("refrain", "bop_refrain", {}, 3.0, True), Rule("stanzas", "stanza_pattern", {"patterns": [[7, 9, 7], [6, 1, 8, 1, 6, 1]]})],
    "sonnet crown": [Rule("links", "sonnet_crown_links", {"sonnet_count": 7}, 3.0, True)],
    "duplex": [Rule("echo", "duplex_echo", {}, 3.0, True), Rule("frame", "first_last_line_echo", {})],
    "ballad": [Rule("rhyme", "rhyme_scheme_repeating", {"scheme": "ABCB"}, 3.0, True), Rule("stresses", "stress_count_pattern_repeating", {"counts": [4, 3]}), Rule("refrain", "stanza_refrain", {})],
    "spenserian": [Rule("rhyme", "rhyme_scheme_repeating", {"scheme": "ABABBCBCC"}, 3.0, True), Rule("last", "terminal_line_longer", {"period": 9})],
    "habbie": [Rule("lengths", "periodic_line_length_relation", {"period": 6, "long_positions": [1, 2, 3, 5], "short_positions": [4, 6]}, 2.0, True)],
    "seguidilla": [Rule("assonance", "seguidilla_assonance", {}, 2.0, True), Rule("pattern", "syllable_pattern_alternatives", {"patterns": [[7, 5, 7, 5, 5, 7, 5], [7, 5, 7, 5]]}, 2.0), Rule("stanzas", "alternating_stanza_sizes", {"sizes": [4, 3]})],
    "romance": [Rule("assonance", "even_line_assonance", {}, 2.0, True), Rule("pattern", "syllable_pattern_repeating", {"counts": [8]})],
    "choka": [Rule("pattern", "choka_syllable_pattern", {}, 3.0, True)],
    "blank verse": [Rule("unrhymed", "rhyme_absence", {"maximum_density": 0.2}, 2.0, True), Rule("syllables", "syllable_range", {"minimum": 9, "maximum": 11}, 2.0)],
    "monorhyme": [Rule("rhyme", "monorhyme", {}, 2.0, True)],
    "alliterative": [Rule("stresses", "stress_count_range", {"minimum": 3, "maximum": 5}, 2.0), Rule("sounds", "alliteration_density", {"minimum": 0.3}, 2.0, True)],
    "ode": [Rule("lengths", "line_length_variation", {"minimum_cv": 0.25}, 2.0), Rule("last", "terminal_line_shorter", {})],
    "canso": [Rule("stanzas", "chanso_architecture", {}, 3.0, True)],
    "lune": [Rule("words", "word_count_pattern", {"counts": [3, 5, 3]}, 3.0, True), Rule("letters", "maximum_word_length", {"maximum": 9})],
    "abecedarian": [Rule("initials", "alphabetic_line_initials", {}, 3.0, True)],
    "calligram": [Rule("shape", "manual_requirement", {}, 3.0, True), Rule("lines", "line_count_range", {"minimum": 2, "maximum": 60})],
}
MODES = {"calligram": "manual", "ode": "partial", "alliterative": "partial"}
FAMILIES = {
    "sonnet": "fixed", "haiku": "syllabic", "limerick": "light", "couplets": "stanzaic", "quatrains": "stanzaic", "villanelle": "refrain", "sestina": "rotation", "pantoum": "refrain", "terza rima": "chain", "ghazal": "refrain", "rubai": "chain", "blues": "refrain",
    "glosa": "refrain", "rondel": "refrain", "rondeau": "refrain", "triolet": "refrain", "terzanelle": "refrain", "rondeau redouble": "refrain", "paradelle": "refrain", "bop": "refrain", "sonnet crown": "fixed", "duplex": "refrain", "ballad": "stanzaic", "spenserian": "stanzaic",
    "habbie": "stanzaic", "seguidilla": "syllabic", "romance": "syllabic", "choka": "syllabic", "blank verse": "stichic", "monorhyme": "stichic", "alliterative": "stichic", "ode": "free", "canso": "fixed", "lune": "syllabic", "abecedarian": "pattern", "calligram": "pattern",
}


def _sounds(spark, sf_dir):
    """work_id, line_no, label, vowel, stresses, credits, qafias of the conversations' lines."""
    lines = _conversation_lines(spark, sf_dir).select("work_id", "line_no", F.transform(F.regexp_extract_all("line", F.lit(base.LETTERS), 0), lambda w: F.lower(w)).alias("ws")).filter(F.size("ws") > 0)
    each = lines.select("work_id", "line_no", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "form"))

    def make():
        known = phonology.dictionary(pronunciations(each.select("form").distinct()))
        rimes = phonology.ending_words(known)
        vowels = F.array_distinct(F.transform("endings", lambda e: e["vowel"]))
        phones = F.get("phones", F.lit(0))
        last = lambda p: F.array_max(F.filter(F.transform(phones, lambda x, i: F.when(x.rlike(p), i)), lambda i: i.isNotNull()))
        start = F.coalesce(last("1$"), last("[012]$"))
        agreed = known.select("form", F.when(F.col("signatures") == 1, F.length(F.regexp_replace("stress", "0", ""))).alias("strong"), F.when((F.col("signatures") == 1) & start.isNotNull(), F.slice(phones, start + 1, F.size(phones))).alias("rime"))
        return rimes.select("form", "part", F.when(F.size(vowels) == 1, F.get(vowels, F.lit(0))).alias("vowel")).join(agreed.hint("shuffle_merge"), "form")

    held = each.join(kept(spark, f"sounds {sf_dir}", make), "form", "left")
    back = lambda k: F.max(F.when(F.col("i") == F.col("n") - 1 - k, F.struct("part", "vowel", "rime")))
    found = held.groupBy("work_id", "line_no").agg(back(0)["part"].alias("label"), back(0)["vowel"].alias("vowel"), F.when(F.count("strong") == F.count("*"), F.sum("strong")).cast("int").alias("stresses"), F.array(*[back(k)["rime"] for k in range(1, 5)]).alias("qafias"))
    pairs = phonology.rhyme_pairs(_endings(spark, sf_dir), _family())
    credit = F.when(F.col("relation") == "slant", 0.45 + 0.45 * F.col("least")).when(F.col("eye"), 0.25)
    credits = pairs.withColumn("credit", credit).filter("credit is not null").groupBy("work_id", F.col("line_a").alias("line_no")).agg(F.collect_list(F.struct(F.col("line_b").alias("line_no"), "credit")).alias("credits"))
    return found.join(credits.hint("shuffle_merge"), ["work_id", "line_no"], "left")


def _observed(spark, sf_dir):
    return written(forms.observations(_conversation_lines(spark, sf_dir), _sounds(spark, sf_dir)), "forms")


# --- the same in SQL ------------------------------------------------------------------------------------

_OBS = f"""{_CONVERSATION}, lw AS MATERIALIZED (SELECT work_id, line_no, stanza_no, [lower(w) for w in ws] AS ws FROM (SELECT *, regexp_extract_all(line, '\\p{{L}}+') AS ws FROM st) WHERE len(ws) > 0),
le AS (SELECT work_id, stanza_no, line_no, ws[-1] AS form FROM lw), lv AS (SELECT DISTINCT unnest(ws) AS form FROM lw), {_PRON('lv')}, {_ENDING},
de AS MATERIALIZED (SELECT DISTINCT lookup_form AS form, part, vowel, stress, syllables, consonants FROM ed), pt AS (SELECT form, CASE WHEN count(DISTINCT part) = 1 THEN any_value(part) END AS part, CASE WHEN count(DISTINCT vowel) = 1 THEN any_value(vowel) END AS vowel FROM de GROUP BY form),
ok AS (SELECT le.*, pt.part, regexp_extract(le.form, '([aeiouy][^aeiouy]*e?)$', 1) AS rime FROM le JOIN pt USING (form)), {_PAIRS},
dc AS (SELECT lookup_form AS form, CASE WHEN count(DISTINCT syllables || ':' || stress) = 1 THEN any_value(length(replace(stress, '0', ''))) END AS strong, CASE WHEN count(DISTINCT syllables || ':' || stress) = 1 THEN arg_min(phones[coalesce(list_max([i for p, i in phones if right(p, 1) = '1']), list_max([i for p, i in phones if regexp_matches(p, '[012]$')])):], variant) FILTER (syllables > 0) END AS rime FROM ps GROUP BY lookup_form),
wd AS MATERIALIZED (SELECT work_id, line_no, stanza_no, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS form, len(ws) AS n FROM lw),
sd AS (SELECT work_id, line_no, CASE WHEN count(strong) = count(*) THEN sum(strong)::INT END AS stresses, [any_value(dc.rime) FILTER (n - i = 1), any_value(dc.rime) FILTER (n - i = 2), any_value(dc.rime) FILTER (n - i = 3), any_value(dc.rime) FILTER (n - i = 4)] AS qafias FROM wd LEFT JOIN dc USING (form) GROUP BY work_id, line_no),
ln2 AS MATERIALIZED (SELECT lw.work_id, lw.line_no, lw.stanza_no, lw.ws, pt.part AS label, pt.vowel, sd.stresses, sd.qafias, row_number() OVER (PARTITION BY lw.work_id ORDER BY lw.line_no)::INT AS place FROM lw JOIN sd USING (work_id, line_no) LEFT JOIN pt ON pt.form = lw.ws[-1]),
cr AS (SELECT a.work_id, list({{'i': a.place, 'j': b.place, 'credit': credit}} ORDER BY a.place, b.place) AS credits FROM (SELECT work_id, line_a, line_b, CASE WHEN relation = 'slant' THEN 0.45 + 0.45 * least WHEN eye THEN 0.25 END AS credit FROM rp) x JOIN ln2 a ON a.work_id = x.work_id AND a.line_no = x.line_a JOIN ln2 b ON b.work_id = x.work_id AND b.line_no = x.line_b WHERE credit IS NOT NULL GROUP BY a.work_id),
sz AS (SELECT work_id, list(k ORDER BY stanza_no) AS stanzas FROM (SELECT work_id, stanza_no, count(*)::INT AS k FROM lw GROUP BY work_id, stanza_no) GROUP BY work_id),
ob AS (SELECT work_id, list(ws ORDER BY place) AS lines, list(list_sum([{_SYLLABLES.replace('form', 'w')} for w in ws])::INT ORDER BY place) AS syllables, list(stresses ORDER BY place) AS stresses, list(ws[-1] ORDER BY place) AS endings, list(nullif(regexp_extract(array_to_string(ws, ' '), '[a-z]'), '') ORDER BY place) AS initials, list(label ORDER BY place) AS labels, list(vowel ORDER BY place) AS vowels, list(qafias ORDER BY place) AS qafias,
list([regexp_extract(w, '^[b-df-hj-np-tv-z]') for w in ws if regexp_matches(w, '^[b-df-hj-np-tv-z]')] ORDER BY place) AS onsets FROM ln2 GROUP BY work_id),
o AS MATERIALIZED (SELECT ob.* EXCLUDE (onsets), [len([1 for c in s if len([1 for d in s if c = d]) > 1]) / nullif(len(s), 0) for s in onsets] AS alliteration, sz.stanzas, coalesce(cr.credits, []) AS credits, len(lines) AS n, len(sz.stanzas) AS m FROM ob JOIN sz USING (work_id) LEFT JOIN cr USING (work_id))"""

_unit = lambda x: f"least(greatest({x}, 0.0), 1.0)"
_near = lambda n, e: _unit(f"1 - abs({n} - {e}) / greatest(2.0, ({e}) * 0.25)")
_inside = lambda x, low, high: _unit(f"1 - greatest({low} - ({x}), ({x}) - {high}, 0.0) / {max(2.0, (high - low + 1) * 0.5)}")
_some = lambda items: f"len([q for q in {items} if q IS NOT NULL])"
_lev = lambda a, b: f"(list_reduce({a}, lambda r, w: list_apply([[CASE WHEN k = 0 THEN r[1] + 1 ELSE least(r[k] + ({b}[k] <> w)::INT, r[k + 1] + 1) - k END for k in range(0, len({b}) + 1)]], lambda c: [list_min(c[1:k + 1]) + k for k in range(0, len({b}) + 1)])[1], range(0, len({b}) + 1))[-1])"
_like = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE 1 - {_lev(a, b)} / greatest(len({a}), len({b})) END)"
_listed = lambda groups: "[" + ", ".join(f"{{'i': {g[0]}, 'j': {x}}}" for g in groups for x in g[1:]) + "]"
_again = lambda pairs: (f"list_avg([{_like('lines[p.i]', 'lines[p.j]')} for p in {pairs} if n >= greatest(p.i, p.j)])", f"coalesce(len([1 for p in {pairs} if n >= greatest(p.i, p.j)]) / nullif(len({pairs}), 0), 0)")
_follow = lambda values, targets, tolerance, whole: (f"list_avg([{_unit(f'1 - abs({values}[k] - ({targets})[k]) / {tolerance}')} for k in range(1, least(len({values}), len({targets})) + 1) if {values}[k] IS NOT NULL])", f"len([1 for k in range(1, least(len({values}), len({targets})) + 1) if {values}[k] IS NOT NULL]) / greatest({whole}, 1)")
_cycle = lambda counts: f"[{list(counts)}[(k - 1) % {len(counts)} + 1] for k in range(1, n + 1)]"
_each = lambda values, low, high: (f"list_avg([{_inside('x', low, high)} for x in {values} if x IS NOT NULL])", f"{_some(values)} / n")
_spread = lambda f: (f"CASE WHEN n >= 3 AND list_avg(syllables) > 0 THEN {f('(list_stddev_pop(syllables) / list_avg(syllables))')} END", "1.0")
_credit = lambda i, j: f"(CASE WHEN labels[{i}] IS NULL OR labels[{j}] IS NULL THEN NULL WHEN labels[{i}] = labels[{j}] THEN 1.0 ELSE coalesce([c.credit for c in credits if c.i = {i} AND c.j = {j}][1], 0.0) END)"
_relate = lambda pairs: (f"list_avg([{_credit('p.i', 'p.j')} for p in {pairs}])", f"coalesce({_some(f'[{_credit("p.i", "p.j")} for p in {pairs}]')} / nullif(len({pairs}), 0), 0)")
_best_of = lambda options: ("list_sort([x for x in [" + ", ".join(f"{{'s': {s}, 'c': {c}}}" for s, c in options) + "] if x.s IS NOT NULL], 'DESC')[1].s", "coalesce(list_sort([x for x in [" + ", ".join(f"{{'s': {s}, 'c': {c}}}" for s, c in options) + "] if x.s IS NOT NULL], 'DESC')[1].c, 0)")
_starts = "[coalesce(list_sum(stanzas[1:k - 1]), 0)::INT for k in range(1, m + 1)]"
_stop = lambda values: f"list_max([len([1 for y in {values} if y = x]) for x in {values} if x IS NOT NULL])"


def _scheme(classes: str):
    """All pairs of lines, those of one class and the others apart."""
    pairs = f"flatten([[{{'i': a, 'j': b}} for b in range(a + 1, len({classes}) + 1)] for a in range(1, len({classes}) + 1)])"
    yes = f"list_avg([{_credit('p.i', 'p.j')} for p in {pairs} if ({classes})[p.i] = ({classes})[p.j]])"
    no = f"list_avg([CASE WHEN labels[p.i] IS NOT NULL AND labels[p.j] IS NOT NULL THEN (labels[p.i] <> labels[p.j])::INT::DOUBLE END for p in {pairs} if ({classes})[p.i] <> ({classes})[p.j]])"
    known = f"len([1 for p in {pairs} if labels[p.i] IS NOT NULL AND labels[p.j] IS NOT NULL])"
    return f"(SELECT coalesce((y + z) / 2, y, z) FROM (SELECT {yes} AS y, {no} AS z))", f"coalesce({known} / nullif(len({pairs}), 0), 0)"


_letters = lambda s: f"({[ord(c) for c in s.replace(' ', '')]})[1:least(n, {len(s.replace(' ', ''))})]"
_block = lambda s: f"[((k - 1) // {len(s)}) * 1000 + {[ord(c) for c in s]}[(k - 1) % {len(s)} + 1] for k in range(1, n + 1)]"
_contrast = lambda long, short: f"CASE WHEN len({long}) > 0 AND len({short}) > 0 THEN {_unit(f'(list_avg({long}) - list_avg({short}) + 1) / 3')} END"
_contrasts = lambda items: (f"list_avg({items})", f"coalesce({_some(items)} / nullif(len({items}), 0), 0)")
_fit = lambda e: f"CASE WHEN stanzas = {list(e)}::INT[] THEN 1.0 ELSE ({_near('m', len(e))} + {_unit(f'1 - list_sum([abs(coalesce(stanzas[k], 0) - coalesce({list(e)}[k], 0)) for k in range(1, greatest(m, {len(e)}) + 1)]) / {max(sum(e), 1)}')}) / 2 END"
_share = lambda test: f"len([1 for s in stanzas if {test}])"
_at = "[k for k in range(1, n + 1) if k <= 2 OR k % 2 = 0]"
_tail = lambda x, k: f"{x}[len({x}) - {k} + 1:]"
_holds = lambda i, k: f"(len(lines[{i}]) >= {k} AND {_tail(f'lines[{i}]', k)} = {_tail('lines[1]', k)})"
_RIMES = f"[qafias[i][k] for i in {_at} if {_holds('i', 'k')} AND len(lines[i]) > k AND qafias[i][k] IS NOT NULL]"
_RADIF = f"""(SELECT CASE WHEN len({_at}) < 4 THEN NULL WHEN support < 0.5 THEN support WHEN len(rimes) >= 2 THEN 0.65 * support + 0.35 * list_avg([CASE WHEN rimes[y] = rimes[1] THEN 1.0 ELSE {_like('rimes[1]', 'rimes[y]')} * 0.6 END for y in range(2, len(rimes) + 1)]) ELSE support END AS score, CASE WHEN len({_at}) < 4 THEN len({_at}) / 6 WHEN support < 0.5 THEN 1.0 ELSE 0.65 + 0.35 * len(rimes) / len({_at}) END AS coverage
FROM (SELECT round(b.s - 0.01 * k, 12) AS support, {_RIMES} AS rimes FROM (SELECT b, -b.less AS k FROM (SELECT list_sort([{{'s': len([1 for i in {_at} if {_holds('i', 'z')}]) / len({_at}) + 0.01 * z, 'less': -z}} for z in [1, 2, 3, 4] if z <= len(lines[1])], 'DESC')[1] AS b))))"""
_SEED = "list_distinct(endings[1:6])"
_envoi = lambda order: "(" + " + ".join(f"(endings[{37 + k}] = endings[{s + 1}])::INT" for k, s in enumerate(order)) + ") / 3"
_prefix = "least(len(lines[{a}]), len(lines[p]), 5)"

_KINDS = {
    "line_count_exact": lambda count: (_near("n", count), "1.0"), "line_count_range": lambda minimum, maximum: (_inside("n", minimum, maximum), "1.0"),
    "word_count_pattern": lambda counts: _follow("[len(x) for x in lines]", counts, 2, len(counts)), "maximum_word_length": lambda maximum: (f"len([1 for w in flatten(lines) if length(w) <= {maximum}]) / len(flatten(lines))", "1.0"),
    "total_syllable_range": lambda minimum, maximum: (_inside("list_sum(syllables)", minimum, maximum), "1.0"), "maximum_total_syllables": lambda maximum: (_unit(f"1 - greatest(list_sum(syllables) - {maximum}, 0) / {maximum}"), "1.0"),
    "syllable_range": lambda minimum, maximum: _each("syllables", minimum, maximum), "stress_count_range": lambda minimum, maximum: _each("stresses", minimum, maximum),
    "stanza_pattern": lambda patterns: (f"greatest({', '.join(map(_fit, patterns))})", "1.0"), "uniform_stanza_size": lambda size, minimum=1: (f"{_share(f's = {size}')} / m * least(1.0, {_share(f's = {size}')} / {minimum})", "1.0"),
    "alternating_stanza_sizes": lambda sizes: (f"list_avg([{_near('stanzas[k]', f'{list(sizes)}[(k - 1) % {len(sizes)} + 1]')} for k in range(1, m + 1)])", "1.0"), "quatrain_sequence": lambda minimum: (f"least(1.0, {_share('s = 4')} / {minimum}) * {_share('s = 4')} / m", "1.0"),
    "terza_stanzas": lambda: ("(SELECT len([1 for s in core if s = 3]) / greatest(len(core), 1) * CASE WHEN stanzas[-1] IN (1, 2, 3) THEN 1.0 ELSE 0.8 END FROM (SELECT CASE WHEN stanzas[-1] IN (1, 2) THEN stanzas[1:m - 1] ELSE stanzas END AS core))", "1.0"),
    "ghazal_architecture": lambda minimum, maximum: (f"(SELECT (c / m + CASE WHEN c BETWEEN {minimum} AND {maximum} THEN 1.0 ELSE {_unit(f'1 - least(abs(c - {minimum}), abs(c - {maximum})) / {minimum}')} END) / 2 FROM (SELECT {_share('s = 2')} AS c))", "1.0"),
    "chanso_architecture": lambda: (f"CASE WHEN m >= 6 THEN (SELECT (len([1 for s in stanzas[1:m - 1] if s = z]) / (m - 1) + {_near('stanzas[-1]', 'greatest(1, round_even(z / 2, 0))')} + greatest({_near('(m - 1)', 5)}, {_near('(m - 1)', 6)})) / 3 FROM (SELECT round_even(list_avg(stanzas[1:m - 1]), 0) AS z)) END", "1.0"),
    "syllable_pattern": lambda counts: _follow("syllables", counts, 3, len(counts)), "syllable_pattern_repeating": lambda counts: _follow("syllables", _cycle(counts), 3, "n"), "syllable_pattern_alternatives": lambda patterns: _best_of([_follow("syllables", p, 3, len(p)) for p in patterns]),
    "choka_syllable_pattern": lambda: _follow("syllables", "[CASE WHEN k % 2 = 0 OR k = n THEN 7 ELSE 5 END for k in range(1, n + 1)]", 3, "n"), "stress_count_pattern_repeating": lambda counts: _follow("stresses", _cycle(counts), 2, "n"),
    "line_length_uniformity": lambda: _spread(lambda cv: _unit(f"1 - {cv} / 0.35")), "line_length_variation": lambda minimum_cv: _spread(lambda cv: _unit(f"{cv} / {minimum_cv}")),
    "terminal_line_longer": lambda period: _contrasts(f"[{_contrast(f'syllables[e:e]', f'syllables[e - {period - 1}:e - 1]')} for e in range({period}, n + 1, {period})]"),
    "periodic_line_length_relation": lambda period, long_positions, short_positions: _contrasts(f"[{_contrast(*[f'[syllables[b + p] for p in {x} if b + p <= n]' for x in (long_positions, short_positions)])} for b in range(0, n, {period})]"),
    "terminal_line_shorter": lambda: (f"CASE WHEN n >= 3 THEN {_unit('(list_avg(syllables[1:n - 1]) - syllables[-1] + 1) / 3')} END", "1.0"),
    "limerick_length_relation": lambda: (f"CASE WHEN n >= 5 THEN (SELECT {_unit('(l - s + 1) / greatest(l * 0.35, 1)')} FROM (SELECT (syllables[1] + syllables[2] + syllables[5]) / 3 AS l, (syllables[3] + syllables[4]) / 2 AS s)) END", "least(n, 5) / 5"),
    "alphabetic_line_initials": lambda: ("list_avg([(unicode(initials[k]) = 96 + k)::INT for k in range(1, least(n, 26) + 1) if initials[k] IS NOT NULL])", f"{_some('initials[1:26]')} / least(n, 26)"),
    "rhyme_scheme": lambda schemes: _best_of([_scheme(_letters(s)) for s in schemes]), "rhyme_scheme_repeating": lambda scheme: _scheme(_block(scheme)),
    "terza_rhyme": lambda: tuple(f"CASE WHEN n >= 6 THEN {x} ELSE {z} END" for x, z in zip(_scheme("[CASE WHEN k % 3 = 2 THEN (k - 1) // 3 + 1 ELSE (k - 1) // 3 END for k in range(1, n // 3 * 3 + 1)]"), ("NULL", "0.0"))),
    "rubaiyat_chain": lambda: _scheme("[CASE WHEN k % 4 = 3 THEN (k - 1) // 4 + 1 ELSE (k - 1) // 4 END for k in range(1, n + 1)]"),
    "rhyme_couplets": lambda: _relate("[{'i': k, 'j': k + 1} for k in range(1, n, 2)]"), "terminal_rhyming_couplet": lambda: _relate("[{'i': k - 1, 'j': k} for k in [n] if k > 1]"), "terminal_pair_rhyme": lambda positions: _relate(_listed([positions])),
    "rhyme_absence": lambda maximum_density: (_unit(f"1 - greatest(len([1 for x in labels if len([1 for y in labels if y = x]) > 1]) / nullif({_some('labels')}, 0) - {maximum_density}, 0) / {1 - maximum_density}").replace("least(greatest(1 - greatest(", f"CASE WHEN {_some('labels')} > 0 THEN least(greatest(1 - greatest(", 1) + " END", f"({_some('labels')} > 0)::INT"),
    "monorhyme": lambda: (f"{_stop('labels')} / nullif({_some('labels')}, 0)", f"{_some('labels')} / n"), "rhyme_class_count": lambda count: (f"CASE WHEN {_some('labels')} > 0 THEN {_near('len(list_distinct(labels))', count)} END", f"{_some('labels')} / n"),
    **{k: lambda: (f"{_stop('[vowels[k] for k in range(2, n + 1, 2)]')} / nullif({_some('[vowels[k] for k in range(2, n + 1, 2)]')}, 0)", f"{_some('[vowels[k] for k in range(2, n + 1, 2)]')} / greatest(n // 2, 1)") for k in ("even_line_assonance", "seguidilla_assonance")},
    **{k: (lambda g: lambda: _again(_listed(g)))(groups) for k, groups in forms.REPEATS.items()}, "line_repetition_groups": lambda groups: _again(_listed(groups)), "first_last_line_echo": lambda: _again("[{'i': 1, 'j': n}]"), "duplex_echo": lambda: _again("[{'i': k, 'j': k + 1} for k in range(2, n, 2)]"),
    "rondel_refrains": lambda: _again(f"(CASE WHEN n >= 14 THEN {_listed([(1, 7, 13), (2, 8, 14)])} ELSE {_listed([(1, 7, 13), (2, 8)])} END)"), "sonnet_crown_links": lambda sonnet_count: _again(_listed([(14 * k, 14 * k + 1) for k in range(1, sonnet_count - 1)])),
    "stanza_refrain": lambda: _again(f"[{{'i': stanzas[1], 'j': ({_starts})[k] + stanzas[k]}} for k in range(2, m + 1)]"),
    "pantoum_repetition": lambda: (_again(x := f"flatten([[{{'i': ({_starts})[k] + 2, 'j': ({_starts})[k + 1] + 1}}, {{'i': ({_starts})[k] + 4, 'j': ({_starts})[k + 1] + 3}}] for k in range(1, m) if stanzas[k] >= 4 AND stanzas[k + 1] >= 3])")[0], f"len({x}) / greatest(2 * (m - 1), 1)"),
    "pantoum_closure": lambda: ("CASE WHEN m >= 2 AND stanzas[1] >= 3 AND stanzas[-1] >= 4 THEN (SELECT greatest((" + _like("lines[1]", "lines[z + 4]") + " + " + _like("lines[3]", "lines[z + 2]") + ") / 2, (" + _like("lines[1]", "lines[z + 2]") + " + " + _like("lines[3]", "lines[z + 4]") + f") / 2) FROM (SELECT ({_starts})[-1] AS z)) END", "1.0"),
    "blues_repetition": lambda: _again(f"[{{'i': s + 1, 'j': s + 2}} for s in (CASE WHEN {_share('s = 3')} > 0 THEN [({_starts})[k] for k in range(1, m + 1) if stanzas[k] = 3] ELSE [(3 * k)::INT for k in range(0, n // 3)] END)]"),
    "partial_refrain_positions": lambda anchor, positions: (f"list_avg([greatest({_like(f'lines[{anchor}]', 'lines[p]')}, {_like(f'lines[{anchor}][1:{_prefix.format(a=anchor)}]', f'lines[p][1:{_prefix.format(a=anchor)}]')}) for p in {positions} if n >= p AND n >= {anchor}])", f"len([1 for p in {positions} if n >= p AND n >= {anchor}]) / {len(positions)}"),
    "sestina_rotation": lambda: (f"CASE WHEN n >= 6 THEN list_avg([(endings[k] = endings[{forms.ROTATION}[k] + 1])::INT for k in range(1, least(n, 36) + 1)]) END", "CASE WHEN n >= 6 THEN least(n, 36) / 36 ELSE 0.0 END"),
    "sestina_envoi": lambda: (f"CASE WHEN n >= 39 THEN (greatest({_envoi((4, 2, 0))}, {_envoi((0, 2, 4))}) + len(list_intersect({_SEED}, flatten(lines[37:39]))) / len({_SEED})) / 2 END", f"CASE WHEN n >= 39 THEN 1.0 ELSE {_unit('(n - 36) / 3')} END"),
    "ghazal_radif_qafia": lambda: (f"(SELECT score FROM {_RADIF})", f"(SELECT coverage FROM {_RADIF})"),
    "alliteration_density": lambda minimum: (_unit(f"list_avg(alliteration) / {minimum}").replace("least(", f"CASE WHEN {_some('alliteration')} > 0 THEN least(", 1) + " END", f"{_some('alliteration')} / n"), "manual_requirement": lambda: ("NULL::DOUBLE", "0.0"),
}


def _scores_sql(*families: str) -> str:
    """(work_id, form, rule, weight, required, score, coverage) of the rules of some families, or of all."""
    rows = []
    for form, rules in REGISTRY.items():
        for rule in rules:
            if not families or forms.KINDS[rule.kind][0] in families:
                score, coverage = _KINDS[rule.kind](**rule.parameters)
                rows.append(f"SELECT work_id, '{form}' AS form, '{rule.name}' AS rule, {rule.weight}::DOUBLE AS weight, {str(rule.required).lower()} AS required, ({score})::DOUBLE AS score, ({coverage})::DOUBLE AS coverage FROM o")
    return "rs AS (" + " UNION ALL ".join(rows) + ")"


def _scored(*families: str) -> str:
    return f"{_OBS}, {_scores_sql(*families)} SELECT work_id, form, rule, weight, required, round(score, 6) AS score, round(coverage, 6) AS coverage FROM rs"


@_query(f"{_OBS} SELECT work_id, lines, stanzas, syllables, stresses, endings, initials, labels, vowels, [round(x, 6) for x in alliteration] AS alliteration, len(credits)::INT AS credits FROM o", prelude=False)
def form_observations(spark, sf_dir):
    found = _observed(spark, sf_dir)
    return found.select("work_id", "lines", "stanzas", "syllables", "stresses", "endings", "initials", "labels", "vowels", F.transform("alliteration", lambda x: F.round(x, 6)).alias("alliteration"), F.size("credits").alias("credits"))


def _scores(spark, sf_dir, *families):
    return forms.score_rules(_observed(spark, sf_dir), REGISTRY, list(families) or None)


@_query(_scored("counts"), prelude=False)
def form_counts(spark, sf_dir):
    return _scores(spark, sf_dir, "counts")


@_query(_scored("stanzas"), prelude=False)
def form_stanza_shape(spark, sf_dir):
    return _scores(spark, sf_dir, "stanzas")


@_query(_scored("lines"), prelude=False)
def form_line_patterns(spark, sf_dir):
    return _scores(spark, sf_dir, "lines")


@_query(_scored("rhyme"), prelude=False)
def form_rhyme_shape(spark, sf_dir):
    return _scores(spark, sf_dir, "rhyme")


@_query(_scored("repetition"), prelude=False)
def form_line_repetition(spark, sf_dir):
    return _scores(spark, sf_dir, "repetition")


@_query(_scored("rotation"), prelude=False)
def form_endword_rotation(spark, sf_dir):
    return _scores(spark, sf_dir, "rotation")


@_query(_scored("radif"), prelude=False)
def form_radif_qafia(spark, sf_dir):
    """The repeated words at line ends, and the rhyme before them."""
    return _scores(spark, sf_dir, "radif")


@_query(_scored("sound"), prelude=False)
def form_sound_density(spark, sf_dir):
    return _scores(spark, sf_dir, "sound")


_MODE = "CASE " + " ".join(f"WHEN form = '{f}' THEN '{m}'" for f, m in MODES.items()) + " ELSE 'automatic' END"


@_query(f"""{_OBS}, {_scores_sql()}, f AS (SELECT work_id, form, {_MODE} AS mode, sum(weight * coverage * score) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight * coverage END), 0) AS consistency, sum(CASE WHEN required THEN weight * coverage * score END) / nullif(sum(CASE WHEN required AND score IS NOT NULL THEN weight * coverage END), 0) AS agreement,
count(*) FILTER (required AND score < 0.2) AS contradictions, coalesce(sum(CASE WHEN score IS NOT NULL THEN weight * coverage END), 0) / sum(weight) AS evidence, coalesce(coalesce(sum(CASE WHEN required AND score IS NOT NULL THEN weight * coverage END), 0) / nullif(sum(CASE WHEN required THEN weight END), 0), 1.0) AS required_evidence FROM rs GROUP BY work_id, form),
k AS (SELECT *, CASE WHEN consistency IS NULL THEN -1.0 ELSE round(consistency * evidence * CASE mode WHEN 'automatic' THEN 1.0 WHEN 'partial' THEN 0.9 ELSE 0.5 END, 9) END AS k, round(coalesce(consistency, -1.0), 9) AS c9 FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY k DESC, c9 DESC, form) AS place FROM k), g AS (SELECT r.*, CASE WHEN consistency IS NOT NULL THEN k - (SELECT arg_min(x.k, x.place) FROM r x WHERE x.work_id = r.work_id AND x.place > r.place AND x.mode <> 'manual' AND x.consistency IS NOT NULL) END AS margin,
coalesce(mode <> 'manual' AND consistency >= 0.45 AND evidence >= 0.7 AND required_evidence >= 0.7 AND contradictions = 0, false) AS suggested, CASE WHEN consistency IS NULL THEN 'No match' WHEN consistency >= 0.95 AND (agreement IS NULL OR agreement >= 0.95) THEN 'Strict' WHEN consistency >= 0.82 THEN 'Strongly conforming' WHEN consistency >= 0.68 THEN 'Modified'
WHEN consistency >= 0.55 THEN 'Form-derived' WHEN consistency >= 0.45 THEN 'Suggestive resemblance' ELSE 'No match' END AS class FROM r)
SELECT work_id, form, mode, round(consistency, 6) AS consistency, round(agreement, 6) AS agreement, contradictions, round(evidence, 6) AS evidence, round(required_evidence, 6) AS required_evidence, class, place, round(margin, 6) AS margin, suggested,
CASE WHEN suggested AND consistency >= 0.75 AND evidence >= 0.75 AND round(coalesce(margin, 0), 9) >= 0.08 THEN 'high' WHEN suggested AND consistency >= 0.58 AND evidence >= 0.5 AND round(coalesce(margin, 0), 9) >= 0.03 THEN 'moderate' ELSE 'low' END AS confidence, CASE WHEN mode = 'manual' THEN 'Manual confirmation required' WHEN suggested THEN class ELSE 'No match' END AS classification FROM g""", prelude=False)
def form_candidates(spark, sf_dir):
    return forms.candidates(_scores(spark, sf_dir), MODES)


@_query(f"""{_OBS}, {_scores_sql()} SELECT fa.family, fa.mode, rs.form, count(*) AS scored, round(avg(score), 6) AS mean_score FROM rs JOIN (VALUES {', '.join(f"('{f}', '{g}', '{MODES.get(f, 'automatic')}')" for f, g in FAMILIES.items())}) fa(form, family, mode) ON fa.form = rs.form
WHERE fa.family IN ('refrain', 'fixed', 'pattern') AND fa.mode <> 'manual' AND contains(rs.form, 'o') GROUP BY fa.family, fa.mode, rs.form""", prelude=False)
def form_registry_filter(spark, sf_dir):
    """Forms of three families that need no confirmation and have an o in their name, with the mean of their rules' scores."""
    chosen = {f: r for f, r in REGISTRY.items() if FAMILIES[f] in ("refrain", "fixed", "pattern") and MODES.get(f) != "manual" and "o" in f}
    pick = lambda table, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("form")), F.lit(other))
    return forms.score_rules(_observed(spark, sf_dir), chosen).groupBy(pick(FAMILIES, "").alias("family"), pick(MODES, "automatic").alias("mode"), "form").agg(F.count("*").alias("scored"), F.avg("score").alias("mean_score"))
