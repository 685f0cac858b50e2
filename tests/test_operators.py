"""Hand-calculated anchors for single operators."""

import pytest
from pyspark.sql import functions as F

from quire.functions.columns import possessive_base, summary, syllables
from quire.operators import corpus, matching, meter, sound, statistics, structure
from quire.sources import files


def sequence(spark, forms, work=1):
    return spark.createDataFrame([(work, i + 1, 1, f) for i, f in enumerate(forms)], "work_id int, pos int, line_no int, form string")


def test_descriptive_statistics(spark):
    r = spark.createDataFrame([(x,) for x in (1.0, 3.0, 5.0, 7.0)], "v double").agg(*summary("v")).first()
    assert (r["mean"], r.median, r.q1, r.q3, r.sd) == (4, 4, 2.5, 5.5, pytest.approx(5**0.5))
    one = spark.createDataFrame([(2.0,)], "v double").agg(*summary("v")).first()
    assert one["count"] == 1 and one["mean"] == 2 and one.sd is None and one.q1 is None


def test_diversity_anchors(spark):
    r = statistics.diversity(sequence(spark, "red blue red green blue yellow red".split()), window=3, draws=3).first()
    assert r.mattr == pytest.approx(14 / 15) and r.hdd == pytest.approx(86 / 105)
    short = statistics.diversity(sequence(spark, "one two three".split())).first()
    assert short.mattr is None and short.hdd is None
    assert statistics.mtld(sequence(spark, "a b a b a b a b".split())).first().mtld == pytest.approx(4.0)
    assert statistics.mtld(sequence(spark, "one two three".split())).first().mtld is None


def test_pooled_profile(spark):
    rows = spark.createDataFrame([("p", 1, 2, 0.2, 0.1), ("p", 2, 3, 0.8, 0.2)], "poet string, work_id int, n int, mean double, sd double")
    r = corpus.pooled_profiles(rows).first()
    assert (r.pooled_mean, r.pooled_sd, r.work_mean, r.work_sd) == tuple(pytest.approx(x) for x in (0.56, 0.1144**0.5, 0.5, 0.3))
    assert corpus.pooled_profiles(rows.withColumn("sd", F.when(F.col("work_id") == 1, F.col("sd")))).first().pooled_sd is None


def test_six_profiles(spark):
    rows = [(1, i, w, v, w == "the", w == "river") for i, (w, v) in enumerate(zip("the bright bright river".split(), (0.5, 0.9, 0.9, 0.3)))]
    got = {(r.scope, r.weighting): r for r in statistics.six_profiles(spark.createDataFrame(rows, "work_id int, pos int, form string, value double, is_stopword boolean, is_content boolean")).collect()}
    assert got["all", "token"]["mean"] == pytest.approx(0.65) and got["all", "type"]["mean"] == pytest.approx(1.7 / 3)
    assert got["content", "token"].matched == 1 and got["content", "token"].sd is None


def test_lines_stanzas_and_phrases(spark):
    works = spark.createDataFrame([(1, "a b\r\n\r\n  very dark night\nsome one\n")], "work_id int, text string")
    lines = structure.stanzas(structure.lines(works)).orderBy("line_no").collect()
    assert [(r.line, r.is_blank, r.indent, r.stanza_no) for r in lines] == [("a b", False, 0, 1), ("", True, 0, 0), ("  very dark night", False, 2, 2), ("some one", False, 0, 2)]
    phrases = spark.createDataFrame([("very dark night",), ("dark night",), ("night some",)], "phrase string")
    got = {r.phrase: (r.selected, r.suppressed_by) for r in matching.phrase_select_longest(matching.phrase_candidates(works, phrases, "[a-z]+")).collect()}
    assert got == {"very dark night": (True, None), "dark night": (False, "very dark night")}


def test_cascade(spark):
    tokens = spark.createDataFrame([(1, 1, "stone's", "stone's"), (1, 2, "broken", "break"), (1, 3, "polish", "polish"), (1, 4, "cry", "cry"), (1, 5, "zzz", "zzz")], "work_id int, pos int, form string, lemma string")
    lexicon = spark.createDataFrame([("stone",), ("break",), ("cry",)], "form string")
    got = {r.form: (r.term, r.method) for r in matching.match_cascade(tokens, lexicon, spark.createDataFrame([("polish",)], "form string")).collect()}
    assert got == {"stone's": ("stone", "possessive"), "broken": ("break", "lemma"), "polish": (None, "collision"), "cry": ("cry", "exact"), "zzz": (None, "unmatched")}


def test_words_and_sound(spark):
    row = spark.createDataFrame([("table", "dogs'", "01010101")], "form string, p string, stress string")
    assert row.select(syllables(F.col("form"))).first()[0] == 2
    assert row.select(possessive_base(F.col("p"))).first()[0] == "dogs"
    fits = {(f.pattern, f.feet): f.fit for f in meter.line_fits(row.selectExpr("array(stress) AS variants")).first().fits}
    assert fits["iambic", 4] == 1.0 and max(fits, key=fits.get) == ("iambic", 4)
    phones = spark.createDataFrame([(["S", "IH1", "L", "V", "ER0"],)], "p array<string>")
    assert phones.select(sound.rhyme_part(F.col("p"))).first()[0] == ["IH", "L", "V", "ER"]


def test_sources(spark, tmp_path):
    (tmp_path / "poet a").mkdir()
    (tmp_path / "poet a" / "one.txt").write_bytes(b"x\r\ny\rz")
    assert [tuple(r) for r in files.scan_corpus_text(spark, str(tmp_path / "poet a")).collect()] == [("poet a/one", "poet a", "one", "x\ny\nz")]
    (tmp_path / "d.dict").write_text(";;; note\nSILVER S IH1 L V ER0\nSILVER(1) S IH1 L V AH0 # rare\n")
    got = files.scan_pronunciation(spark, str(tmp_path / "d.dict")).orderBy("variant").collect()
    assert [(r.lookup_form, r.variant, r.stress, r.syllables) for r in got] == [("silver", 1, "10", 2), ("silver", 2, "10", 2)]
