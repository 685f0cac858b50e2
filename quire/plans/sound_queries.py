"""Queries of pronunciation, rhyme, rhythm and pauses, with their SQL.

Pronunciations are derived from spelling: a vowel letter is a vowel phone whose stress is a digit of the word's
hash, any other letter a consonant of one capital.  Five words in eight are listed, a quarter of those twice.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phonology, sound, structure
from ..sources.tables import kept, written
from . import base
from .queries import _CONVERSATION, _conversation_lines, _query

VOWELS = list("aeiouy")
#: Vowels that are near to each other.
FAMILIES = {"a": "back", "o": "back", "u": "back", "e": "front", "i": "front", "y": "front"}
_HEX = lambda at, length: f"('0x' || substr(md5(form), {at}, {length}))::INT"


def _family():
    return F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])


def pronunciations(forms):
    """lookup_form, variant, phones, stress, syllables of a table of forms."""
    listed = forms.filter(base.digit("form", 17, 1) < 10)
    each = listed.withColumn("variant", F.explode(F.when(base.digit("form", 18, 1) < 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    hashed = F.md5(F.concat("form", F.col("variant").cast("string")).cast("binary"))
    stress = lambda i: (F.conv(F.substring(hashed, i % 30 + 1, F.lit(1)), 16, 10).cast("int") % 3).cast("string")
    letters = F.filter(F.split("form", ""), lambda c: c != "")
    phones = F.transform(letters, lambda c, i: F.when(c.isin(VOWELS), F.concat(c, stress(i))).otherwise(F.chr((65 + F.ascii(c) % 26).cast("long"))))
    rows = each.select(F.col("form").alias("lookup_form"), "variant", phones.alias("phones"))
    marks = F.filter("phones", lambda p: p.rlike("[012]$"))
    return rows.withColumn("stress", F.array_join(F.transform(marks, lambda p: F.right(p, F.lit(1))), "")).withColumn("syllables", F.size(marks))


_PRON = lambda vocabulary: f"""pr AS (SELECT form AS lookup_form, v AS variant, [CASE WHEN c IN ('a', 'e', 'i', 'o', 'u', 'y') THEN c || (('0x' || substr(md5(form || v), (i - 1) % 30 + 1, 1))::INT % 3) ELSE chr((65 + unicode(c) % 26)::INT) END for c, i in string_split(form, '')] AS phones
FROM {vocabulary}, (SELECT unnest([1, 2]) AS v) WHERE {_HEX(17, 1)} < 10 AND (v = 1 OR {_HEX(18, 1)} < 4)),
ps AS (SELECT *, array_to_string([right(p, 1) for p in phones if regexp_matches(p, '[012]$')], '') AS stress, len([p for p in phones if regexp_matches(p, '[012]$')]) AS syllables FROM pr)"""


def _dictionary(spark, sf_dir):
    return kept(spark, f"dictionary {sf_dir}", lambda: phonology.dictionary(pronunciations(base.lexicon(spark, sf_dir).select("form"))))


def _status(spark, sf_dir):
    """form, status, resolved, stress, syllables of every word of the works."""
    def make():
        lexicon = base.lexicon(spark, sf_dir)
        own = lexicon.filter(base.digit("form", 19, 1) == 0).select("form", F.lit("10").alias("own_stress"), F.lit(2).alias("own_syllables"))
        return phonology.resolve(lexicon.select("form"), _dictionary(spark, sf_dir), own)

    return kept(spark, f"status {sf_dir}", make)


def _resolved(spark, sf_dir):
    return base.words(spark, sf_dir).join(_status(spark, sf_dir), "form")


def _pronounced(spark, sf_dir):
    """Words with what is known of their pronunciation, a work's in one task."""
    return base.placed(base.words(spark, sf_dir), _status(spark, sf_dir), "pos", "line_no", how="inner")


_RESOLVED = f"""{_PRON('vocab')}, dc AS (SELECT lookup_form AS form, count(*) AS variants, count(DISTINCT syllables || ':' || stress) AS signatures, min(syllables) AS least, any_value(stress) AS stress, any_value(syllables) AS syllables FROM ps GROUP BY lookup_form),
rs AS (SELECT t.*, CASE WHEN {_HEX(19, 1).replace('form', 't.form')} = 0 THEN 'override' WHEN variants IS NULL THEN 'unmatched' WHEN least = 0 THEN 'no_vowel' WHEN variants = 1 THEN 'unique' WHEN signatures = 1 THEN 'consensus' ELSE 'ambiguous' END AS status, dc.stress AS ds, dc.syllables AS dsy FROM t LEFT JOIN dc ON dc.form = t.form),
rz AS (SELECT work_id, pos, line_no, line_pos, form, status, status IN ('override', 'unique', 'consensus') AS resolved, CASE WHEN status = 'override' THEN '10' WHEN status IN ('unique', 'consensus') THEN ds END AS stress, CASE WHEN status = 'override' THEN 2 WHEN status IN ('unique', 'consensus') THEN dsy END AS syllables FROM rs)"""


@_query(f", {_RESOLVED} SELECT work_id, pos, form, status, resolved, stress, syllables FROM rz")
def pronunciation_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir).select("work_id", "pos", "form", "status", "resolved", "stress", "syllables")


@_query(f""", {_RESOLVED}, l AS (SELECT work_id, line_no, count(*) AS eligible, count(*) FILTER (resolved) AS resolved, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmatched') AS unmatched, sum(syllables)::BIGINT AS al, string_agg(coalesce(stress, ''), '' ORDER BY pos) AS sq FROM rz GROUP BY work_id, line_no)
SELECT work_id, line_no, eligible, resolved, ambiguous, unmatched, round(resolved / eligible, 6) AS coverage, CASE WHEN resolved = eligible THEN al END AS syllables, CASE WHEN resolved = eligible THEN sq END AS stress, CASE WHEN resolved = eligible AND al > 0 THEN round(length(replace(sq, '0', '')) / al, 6) END AS stress_density FROM l""")
def pronunciation_lines(spark, sf_dir):
    return phonology.pronounced_lines(_pronounced(spark, sf_dir))


@_query(f", {_RESOLVED} SELECT form, count(*) AS occurrences, list_sort(list(DISTINCT status)) AS statuses, CASE WHEN count(DISTINCT stress) = 1 THEN max(stress) END AS stress, CASE WHEN count(DISTINCT syllables) = 1 THEN max(syllables) END AS syllables FROM rz GROUP BY form")
def pronunciation_types(spark, sf_dir):
    counts = base.plain_words(spark, sf_dir).groupBy("form").agg(F.count("*").alias("n"))
    return phonology.pronounced_types(counts.join(_status(spark, sf_dir), "form"))


_ENDING = """ix AS (SELECT lookup_form, variant, phones, coalesce(list_max([i for p, i in phones if right(p, 1) = '1']), list_max([i for p, i in phones if right(p, 1) = '2']), list_max([i for p, i in phones if right(p, 1) = '0'])) AS s FROM ps),
sx AS (SELECT lookup_form, variant, phones[s:] AS x FROM ix WHERE s IS NOT NULL), vx AS (SELECT *, [p for p in x if regexp_matches(p, '[012]$')] AS vs, list_max([i for p, i in x if regexp_matches(p, '[012]$')]) AS lv FROM sx),
ed AS (SELECT lookup_form, variant, array_to_string([regexp_replace(p, '[012]$', '') for p in x], ' ') AS part, regexp_replace(x[1], '[012]$', '') AS vowel, array_to_string([right(p, 1) for p in vs], '') AS stress, len(vs) AS syllables, array_to_string(x[lv + 1:], ' ') AS consonants,
CASE WHEN len(vs) = 1 THEN 'masculine' WHEN right(vs[-1], 1) = '0' THEN 'feminine' ELSE 'multisyllabic' END AS shape FROM vx)"""


@_query(f", {_PRON('vocab')}, {_ENDING} SELECT * FROM ed")
def rhyme_part(spark, sf_dir):
    rows = pronunciations(base.words(spark, sf_dir).select("form").distinct())
    return rows.withColumn("e", phonology.ending(F.col("phones"))).filter("e is not null").select("lookup_form", "variant", "e.part", "e.vowel", "e.stress", "e.syllables", "e.consonants", "e.shape")


def _endings(spark, sf_dir):
    """Last words of the conversations' lines, with what they rhyme on."""
    words = F.regexp_extract_all("line", F.lit(base.LETTERS), 0)
    lines = _conversation_lines(spark, sf_dir).withColumn("ws", words).filter(F.size("ws") > 0)
    lines = lines.select("work_id", "stanza_no", "line_no", F.lower(F.element_at("ws", -1)).alias("form"))
    known = kept(spark, f"rhymes {sf_dir}", lambda: phonology.ending_words(phonology.dictionary(pronunciations(lines.select("form").distinct()))))
    return lines.join(known, "form", "left").withColumn("endings", F.coalesce("endings", F.array().cast(known.schema["endings"].dataType))).withColumn("rime", sound.eye_rime(F.col("form")))


_LINES = f"""{_CONVERSATION}, le AS (SELECT work_id, stanza_no, line_no, lower(ws[-1]) AS form FROM (SELECT *, regexp_extract_all(line, '\\p{{L}}+') AS ws FROM st) WHERE len(ws) > 0), lv AS (SELECT DISTINCT form FROM le), {_PRON('lv')}, {_ENDING},
de AS (SELECT DISTINCT lookup_form AS form, part, vowel, stress, syllables, consonants FROM ed), pt AS (SELECT form, CASE WHEN count(DISTINCT part) = 1 THEN any_value(part) END AS part FROM de GROUP BY form),
ok AS (SELECT le.*, pt.part, regexp_extract(le.form, '([aeiouy][^aeiouy]*e?)$', 1) AS rime FROM le JOIN pt USING (form))"""
_EDIT = lambda a, b: f"(CASE WHEN replace({a}, ' ', '') = replace({b}, ' ', '') THEN 1.0 ELSE greatest(0.0, 1 - levenshtein(replace({a}, ' ', ''), replace({b}, ' ', '')) / greatest(length(replace({a}, ' ', '')), length(replace({b}, ' ', '')))) END)"
_FRONT = lambda c: f"({c} IN ('e', 'i', 'y'))"
_PAIRS = f"""pp AS (SELECT x.work_id, x.stanza_no, x.line_no AS line_a, y.line_no AS line_b, x.form AS form_a, y.form AS form_b, x.part AS part_a, y.part AS part_b, x.rime AS rime_a, y.rime AS rime_b FROM ok x JOIN ok y ON x.work_id = y.work_id AND x.stanza_no = y.stanza_no AND x.line_no < y.line_no),
kd AS (SELECT DISTINCT form_a, form_b FROM pp), sc AS (SELECT form_a, form_b, min(s) AS least, max(s) AS most FROM (SELECT form_a, form_b, 0.35 * (CASE WHEN a.vowel = b.vowel THEN 1.0 WHEN {_FRONT('a.vowel')} = {_FRONT('b.vowel')} THEN 0.6 ELSE 0.0 END) + 0.25 * {_EDIT('a.consonants', 'b.consonants')} + 0.25 * {_EDIT('a.part', 'b.part')} + 0.10 * {_EDIT('a.stress', 'b.stress')}
+ 0.05 * (CASE WHEN a.syllables = b.syllables THEN 1.0 ELSE 1 - abs(a.syllables - b.syllables) / greatest(a.syllables, b.syllables) END) AS s FROM kd JOIN de a ON a.form = form_a JOIN de b ON b.form = form_b) GROUP BY form_a, form_b),
rp AS (SELECT pp.work_id, stanza_no, line_a, line_b, form_a, form_b, least, most, CASE WHEN part_a = part_b AND form_a = form_b THEN 'identical' WHEN part_a = part_b THEN 'perfect' WHEN round(least, 9) >= 0.68 THEN 'slant' WHEN round(most, 9) >= 0.68 THEN 'ambiguous' ELSE 'none' END AS relation,
length(rime_a) >= 2 AND rime_a = rime_b AND NOT coalesce(part_a = part_b, false) AS eye FROM pp JOIN sc USING (form_a, form_b))"""


@_query(f"{_LINES}, {_PAIRS} SELECT work_id, stanza_no, line_a, line_b, form_a, form_b, round(least, 6) AS least, round(most, 6) AS most, relation, eye FROM rp", prelude=False)
def rhyme_pairs(spark, sf_dir):
    return phonology.rhyme_pairs(_endings(spark, sf_dir), _family())


@_query(f"{_LINES}, {_PAIRS} SELECT DISTINCT form_a, form_b, round(least, 6) AS least, round(most, 6) AS most FROM rp", prelude=False)
def rhyme_similarity(spark, sf_dir):
    return phonology.rhyme_pairs(_endings(spark, sf_dir), _family()).select("form_a", "form_b", "least", "most").distinct()


@_query(f"""{_LINES}, {_PAIRS}, l AS (SELECT work_id, stanza_no, count(*) AS lines, count(pt.form) AS analysed FROM le LEFT JOIN pt USING (form) GROUP BY work_id, stanza_no), c AS (SELECT work_id, stanza_no, count(*) FILTER (relation IN ('perfect', 'identical')) AS perfect, count(*) FILTER (relation = 'slant') AS slant FROM rp GROUP BY work_id, stanza_no),
h AS (SELECT work_id, stanza_no, count(DISTINCT x) AS rhymed FROM (SELECT work_id, stanza_no, unnest([line_a, line_b]) AS x FROM rp WHERE relation IN ('perfect', 'identical')) GROUP BY work_id, stanza_no)
SELECT l.work_id, l.stanza_no, lines, analysed, coalesce(perfect, 0) AS perfect, coalesce(slant, 0) AS slant, coalesce(rhymed, 0)::INT AS rhymed, round(analysed / lines, 6) AS coverage, CASE WHEN analysed > 0 THEN round(coalesce(rhymed, 0) / analysed, 6) END AS density FROM l LEFT JOIN c USING (work_id, stanza_no) LEFT JOIN h USING (work_id, stanza_no)""", prelude=False)
def rhyme_summary(spark, sf_dir):
    endings = _endings(spark, sf_dir)
    return phonology.rhyme_summary(endings, phonology.rhyme_pairs(endings, _family()))


@_query(f", {_PRON('vocab')}, w AS (SELECT t.work_id, t.line_no, unnest(phones) AS p FROM t JOIN ps ON ps.lookup_form = t.form AND variant = 1), s AS (SELECT work_id, line_no, CASE WHEN regexp_matches(p, '[012]$') THEN 'vowel' ELSE 'consonant' END AS category, regexp_replace(p, '[012]$', '') AS sound FROM w), c AS (SELECT work_id, category, sound, count(*) AS n, count(DISTINCT line_no) AS lines FROM s GROUP BY work_id, category, sound) SELECT *, round(n / sum(n) OVER (PARTITION BY work_id, category), 6) AS share FROM c")
def sound_families(spark, sf_dir):
    """Sounds of each word's first pronunciation."""
    phones = _dictionary(spark, sf_dir).select("form", F.array_join(F.get("phones", F.lit(0)), " ").alias("phones"))
    words = base.placed(base.line_words(spark, sf_dir), phones, "line_no", how="inner")
    p = F.col("p")
    sounds = words.select("work_id", "line_no", F.explode(F.split("phones", " ")).alias("p")).select("work_id", "line_no", F.when(p.rlike("[012]$"), "vowel").otherwise("consonant").alias("category"), F.regexp_replace(p, "[012]$", "").alias("sound"))
    return phonology.sound_families(sounds)


_TOKENS = """tt AS (SELECT work_id, line_no, j AS line_pos, ws[j] AS surface, NOT regexp_matches(ws[j], '[\\p{L}\\p{N}]') AS is_punct FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM (SELECT *, regexp_extract_all(line, '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*|[^\\s\\p{L}\\p{N}]') AS ws FROM ln)))"""


@_query(f""", {_TOKENS}, b AS (SELECT *, max(CASE WHEN NOT is_punct THEN line_pos END) OVER (PARTITION BY work_id, line_no ORDER BY line_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(CASE WHEN NOT is_punct THEN line_pos END) OVER (PARTITION BY work_id, line_no ORDER BY line_pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
CASE WHEN regexp_matches(surface, '[;:—–!?]') THEN 'strong' WHEN regexp_matches(surface, '[,…-]') THEN 'moderate' END AS strength FROM tt)
SELECT work_id, line_no, line_pos, surface, before, after, strength, CASE WHEN strength = 'strong' THEN 0.86 ELSE 0.68 END::DOUBLE AS confidence FROM b WHERE is_punct AND strength IS NOT NULL AND before IS NOT NULL AND after IS NOT NULL""")
def caesurae(spark, sf_dir):
    return phonology.caesurae(structure.work_tokens(base.works(spark, sf_dir)))


@_query(f""", {_RESOLVED}, sy AS (SELECT rz.work_id, rz.line_no, rz.pos, k AS syllable, substr(rz.stress, k, 1) AS digit, tg.tag IN ('ADP', 'DET', 'PRON') AS fn, rz.line_pos = max(rz.line_pos) OVER (PARTITION BY rz.work_id, rz.line_no) AND k = length(rz.stress) AS final FROM (SELECT *, unnest(range(1, greatest(coalesce(length(stress), 0), 0) + 1)) AS k FROM rz) rz JOIN tg ON tg.form = rz.form)
SELECT work_id, line_no, pos, syllable, digit, round(least(CASE WHEN digit = '1' THEN 1.0 WHEN digit = '2' THEN 0.68 WHEN fn THEN 0.12 ELSE 0.34 END + CASE WHEN final THEN 0.08 ELSE 0 END, 1.0), 6)::DOUBLE AS prominence FROM sy""".replace("max(rz.line_pos) OVER (PARTITION BY rz.work_id, rz.line_no)", "rz.line_end").replace("SELECT *, unnest(range", "SELECT *, max(line_pos) OVER (PARTITION BY work_id, line_no) AS line_end, unnest(range"))
def stress_prominence(spark, sf_dir):
    from pyspark.sql import Window

    end = F.max("line_pos").over(Window.partitionBy("work_id", "line_no"))
    known = written(_status(spark, sf_dir).select("form", "stress").join(base.tags(spark, sf_dir).select("form", F.col("tag").isin("ADP", "DET", "PRON").alias("fn")), "form"), "known")
    rows = base.words(spark, sf_dir).select("work_id", "pos", "line_no", "line_pos", "form").withColumn("end", end).join(known, "form")
    each = rows.filter("length(stress) > 0").select("work_id", "line_no", "pos", "fn", "line_pos", "end", F.length("stress").alias("n"), F.posexplode(F.filter(F.split("stress", ""), lambda c: c != "")).alias("k", "digit"))
    final = (F.col("line_pos") == F.col("end")) & (F.col("k") + 1 == F.col("n"))
    return each.select("work_id", "line_no", "pos", (F.col("k") + 1).alias("syllable"), "digit", phonology.prominence(F.col("digit"), F.col("fn"), final).alias("prominence"))


@_query(f""", {_RESOLVED}, l AS (SELECT work_id, line_no, count(*) AS n, count(*) FILTER (resolved) AS r, sum(syllables)::BIGINT AS syllables FROM rz GROUP BY work_id, line_no), k AS (SELECT work_id, line_no AS place, syllables FROM l WHERE n = r),
sh AS (SELECT work_id, syllables, count(*) / sum(count(*)) OVER (PARTITION BY work_id) AS s FROM k GROUP BY work_id, syllables), md AS (SELECT work_id, round(-sum(s * log2(s)), 6) + 0.0 AS entropy, round(max(s), 6) AS modal_share FROM sh GROUP BY work_id)
SELECT k.work_id, count(*) AS lines, round(avg(syllables), 6) AS mean, round(stddev_pop(syllables), 6) AS sd, any_value(entropy) AS entropy, any_value(modal_share) AS modal_share, count(DISTINCT CASE WHEN place % 2 = 1 THEN syllables END) = 1 AND count(DISTINCT CASE WHEN place % 2 = 0 THEN syllables END) = 1 AND count(DISTINCT syllables) = 2 AS alternates FROM k JOIN md USING (work_id) GROUP BY k.work_id""")
def rhythm_series(spark, sf_dir):
    lines = phonology.pronounced_lines(_pronounced(spark, sf_dir)).filter("syllables is not null").select("work_id", F.col("line_no").alias("place"), "syllables")
    return phonology.rhythm(lines)
