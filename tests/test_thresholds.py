"""Values that stand exactly on a threshold or on a half, whatever the order in which their parts are added."""

from pyspark.sql import functions as F

from quire.functions.columns import half_up
from quire.operators import meter, phonology, sound
from quire.plans import sound_queries


def test_rhymes_on_the_threshold(spark):
    """These pairs score 0.68 in exact arithmetic, and a little less as a sum of doubles."""
    said = [(1, "la"), (1, "auxaieau"), (2, "esbo"), (2, "boieue"), (3, "duaiouaieau"), (3, "la"), (4, "the"), (4, "inonreouou")]
    lines = spark.createDataFrame([(1, n, i, w) for i, (n, w) in enumerate(said)], "work_id long, stanza_no int, line_no int, form string")
    known = phonology.ending_words(phonology.dictionary(sound_queries.pronunciations(lines.select("form").distinct())))
    endings = lines.join(known, "form").withColumn("rime", sound.eye_rime(F.col("form")))
    rows = phonology.rhyme_pairs(endings, sound_queries._family()).collect()
    assert {r.stanza_no: r.relation for r in rows} == {1: "slant", 2: "ambiguous", 3: "ambiguous", 4: "slant"}
    assert {r.stanza_no: r.slant for r in phonology.rhyme_summary(endings, phonology.rhyme_pairs(endings, sound_queries._family())).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_a_fit_a_bit_below_a_half_goes_down(spark):
    """31.7 of 64 syllables: the double is a bit less than 0.5046875."""
    stress = "f002f200f010121100f012f20002f2ff0000ff21f012ff2f00222fff0000111f"
    fits = meter.line_fits(spark.createDataFrame([([stress],)], "variants array<string>"))
    best = F.array_max(F.transform("fits", lambda f: f["fit"]))
    assert fits.select(half_up(best)).collect()[0][0] == 0.504687
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.25,), (0.1234565,), (1.0,)], "x double").select(half_up(F.col("x"), 1)).collect()] == [0.0, 0.3, 0.1, 1.0]


def test_a_word_without_an_option_counts_before_overflow(spark):
    """1,100 words with two options each are beyond a double; times nothing they are still nothing."""
    two = [["0", "1"]] * 1100
    rows = spark.createDataFrame([(1, [*two, []]), (2, [[], *two]), (3, two), (4, [["0", "1"], ["1"]])], "id int, options array<array<string>>")
    got = {r.id: (r["count"], r.status, r.variants) for r in meter.line_status(meter.stress_variants(rows)).collect()}
    assert got == {1: (0.0, "missing", None), 2: (0.0, "missing", None), 3: (float("inf"), "too_many", None), 4: (2.0, "analysed", ["01", "11"])}
