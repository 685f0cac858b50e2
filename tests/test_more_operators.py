"""Anchors for phrases, review rules, look-ups, rhyme, metre and forms; results worked out by hand or by loops."""

import itertools

from pyspark.sql import functions as F

from quire.operators import exports, lookup, meter, phonology, review, sound, structure
from quire.sources import files


def test_phrase_policy_and_scope(spark):
    tokens = spark.createDataFrame([(1, i + 1, w, v, c) for i, (w, v, c) in enumerate([("very", None, False), ("dark", 3.0, True), ("night", 4.0, True), ("glow", 7.0, False)])], "work_id long, pos int, form string, value double, is_content boolean")
    spans = spark.createDataFrame([(1, 1, 3, "very dark night", True), (1, 2, 3, "dark night", False)], "work_id long, first int, last int, phrase string, selected boolean")
    got = {(r.unit, r.kind): r.selection for r in review.phrase_policy(tokens, spans, "phrase_preferred").collect()}
    assert got == {("very", "word"): "suppressed_component", ("dark", "word"): "suppressed_component", ("night", "word"): "suppressed_component", ("glow", "word"): "included", ("very dark night", "phrase"): "included", ("dark night", "phrase"): "suppressed_overlap"}
    assert review.phrase_policy(tokens, spans, "unigram_only").count() == 4
    assert {r.pos: r.eligible for r in review.phrase_scope(tokens, spans, "is_content").collect()} == {1: True, 2: True, 3: True, 4: False}


def test_narrow_rules_win_and_equal_ones_conflict(spark):
    tokens = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (2, 1, "x"), (2, 2, "y")], "work_id long, pos int, form string")
    rules = [("r1", "map", "global", "x", "a", None, None), ("r2", "map", "work", "x", "b", 1, None), ("r3", "map", "occurrence", "x", "c", 1, 2), ("r4", "map", "global", "y", "d", None, None), ("r5", "map", "global", "y", "e", None, None)]
    table = spark.createDataFrame(rules, "rule_id string, action string, scope string, source_form string, target string, rule_work long, rule_pos int")
    got = {(r.work_id, r.pos): (r.target, r.conflict) for r in review.review_map(tokens, table).collect()}
    assert got == {(1, 1): ("b", False), (1, 2): ("c", False), (2, 1): ("a", False), (2, 2): (None, True)}


def test_suggestions_equal_a_plain_search(spark):
    listed = ["stone", "stones", "store", "shore", "stern", "s", "stoney", "alone", "atone", "storm"]
    asked = ["stonr", "st", "alon", "zzz"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for i, y in enumerate(b):
                new.append(min(row[i] + (x != y), row[i + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    want = {}
    for t in asked:
        near = sorted((-(1 - distance(t, w) / max(len(t), len(w))), w) for w in listed if w != t)
        want |= {(t, i + 1): w for i, (s, w) in enumerate([x for x in near if -x[0] >= 0.72][:8])}
    got = lookup.term_suggestions(spark.createDataFrame([(t,) for t in asked], "term string"), spark.createDataFrame([(w,) for w in listed], "form string")).collect()
    assert {(r.term, r.place): r.form for r in got} == want


PHONES = {"cat": "K AE1 T", "night": "N AY1 T", "hat": "HH AE1 T", "bright": "B R AY1 T", "silver": "S IH1 L V ER0"}


def test_rhyme_anchor(spark):
    rows = spark.createDataFrame([(w, 1, p.split(), "1", 1) for w, p in PHONES.items()], "lookup_form string, variant int, phones array<string>, stress string, syllables int")
    words = phonology.ending_words(phonology.dictionary(rows))
    lines = spark.createDataFrame([(1, 1, i + 1, w) for i, w in enumerate(["cat", "night", "hat", "bright"])], "work_id long, stanza_no int, line_no int, form string")
    endings = lines.join(words, "form").withColumn("rime", sound.eye_rime(F.col("form")))
    pairs = phonology.rhyme_pairs(endings, F.create_map(F.lit("AE"), F.lit("a"), F.lit("AY"), F.lit("i")))
    assert {(r.line_a, r.line_b): r.relation for r in pairs.collect() if r.relation == "perfect"} == {(1, 3): "perfect", (2, 4): "perfect"}
    summary = phonology.rhyme_summary(endings, pairs).first()
    assert (summary.perfect, summary.density, summary.coverage) == (2, 1.0, 1.0)
    assert "".join(r.label for r in sound.rhyme_scheme(endings.select("work_id", "line_no", "part")).orderBy("line_no").collect()) == "ABAB"


def test_stress_variants_and_best_template(spark):
    lines = spark.createDataFrame([(1, 1, 1, [["0", "1"], ["1"], ["01"]]), (1, 1, 2, [["0", "1"]] * 9), (1, 1, 3, [["01"]] * 5)], "work_id long, stanza_no int, line_no int, options array<array<string>>")
    got = {r.line_no: r for r in meter.stress_variants(lines).collect()}
    assert sorted(got[1].variants) == ["".join(x) for x in sorted(itertools.product(["0", "1"], ["1"], ["01"]))]
    assert got[2].variants is None and got[2]["count"] == 512
    status = meter.line_status(meter.stress_variants(lines))
    fitted = meter.line_fits(status.filter("status = 'analysed'").select("work_id", "stanza_no", "line_no", "variants"))
    best = meter.line_best(fitted)
    first = {r.line_no: (r.pattern, r.feet, r.fit) for r in best.filter("place = 1").collect()}
    assert first == {1: ("iambic", 2, 1.0), 3: ("iambic", 5, 1.0)}
    work = meter.work_summary(status, fitted).first()
    assert (work.eligible, work.analysed, work.dominant_pattern, work.dominant_feet) == (3, 2, "iambic", None)
    stanza = meter.stanza_summary(best).first()
    assert (stanza.primary, stanza.secondary, stanza.exceptions) == ("iambic 2", "iambic 5", [3])
    assert {r.form: r.score for r in meter.form_shape(fitted, {"sonnet": ("iambic", 5)}).collect()}["sonnet"] > 0


def test_appended_works(spark):
    corpus = spark.createDataFrame([("a/One.txt", "x")], "path string, text string")
    new = spark.createDataFrame([("a/one.txt", "y"), ("a/two.txt", "z"), ("a/three.doc", "z"), ("../b.txt", "z"), ("a/four.txt", " "), ("a/five.txt", "1"), ("A/FIVE.txt", "2")], "path string, text string")
    added, rejected = exports.append_works(corpus, new)
    assert [r.path for r in added.collect()] == ["a/two.txt"]
    assert {r.path: r.reason for r in rejected.collect()} == {"a/one.txt": "clash", "a/three.doc": "not_text", "../b.txt": "outside", "a/four.txt": "blank", "a/five.txt": "clash", "A/FIVE.txt": "clash"}


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Word,V.Mean,V.SD,V.Rat,A.Mean,A.SD,A.Rat,D.Mean,D.SD,D.Rat\nStone,5,1,20,4,2,21,3,1,22\n")
    r = files.scan_vad_csv(spark, str(tmp_path / "v.csv")).first()
    assert (r.term, r.valence, r.arousal_sd, r.dominance_raters) == ("stone", 5.0, 2.0, 22)
    (tmp_path / "e.tsv").write_text("joy\tanger\t0\njoy\tjoy\t1\nhalf\tjoy\t1\n")
    assert [tuple(r) for r in files.scan_emotion_tsv(spark, str(tmp_path / "e.tsv"), 2).collect()] == [("joy", ["joy"], 2)]
    (tmp_path / "i.tsv").write_text("rage\tanger\t0.8\nrage\tfear\t0.2\n")
    assert files.scan_intensity_tsv(spark, str(tmp_path / "i.tsv")).first().intensities == {"anger": 0.8, "fear": 0.2}
