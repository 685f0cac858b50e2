"""Steps that meet what is known of a form in one join, and count in a work's own rows: results against plain loops, and exchanges."""

from pyspark.sql import functions as F

from quire.operators import matching, review


def exchanges(df) -> int:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


RULES = [
    ("a", "map", "global", "x", "t1", None, None), ("b", "map", "project", "x", "t2", None, None), ("c", "map", "work", "x", "t3", 1, None), ("d", "map", "occurrence", "x", "t4", 2, 3),
    ("e", "map", "occurrence", "x", "t5", 2, 3), ("f", "exclude", "global", "x", None, None, None), ("g", "exclude", "work", "x", None, 3, None), ("h", "exclude", "work", "y", None, 1, None),
]


def _rules(spark):
    return spark.createDataFrame(RULES, "rule_id string, action string, scope string, source_form string, target string, rule_work long, rule_pos int")


def test_rules_that_cover_a_token(spark):
    """the same rules whether a form's narrow rules are held in its row or met by work."""
    rows = [(w, p, f) for w in (1, 2, 3) for p, f in ((1, "x"), (2, "y"), (3, "x"), (4, "z"))]
    tokens = spark.createDataFrame(rows, "work_id long, pos int, form string")
    for held in (0, 1, 64):
        for r in review.with_rules(tokens, _rules(spark), held=held).collect():
            want = {i for i, _, _, f, _, w, p in RULES if f == r.form and w in (None, r.work_id) and p in (None, r.pos)}
            assert {x.rule_id for x in r.rules or []} == want, (held, r)
    got = {(r.work_id, r.pos): (r.scope, r.target, r.conflict) for r in review.review_map(tokens, _rules(spark)).collect()}
    assert got == {(1, 1): ("work", "t3", False), (1, 3): ("work", "t3", False), (2, 1): ("project", "t2", False), (2, 3): ("occurrence", None, True), (3, 1): ("project", "t2", False), (3, 3): ("project", "t2", False)}
    got = {(r.work_id, r.pos): r.revisions for r in review.review_exclude(tokens, _rules(spark)).collect() if r.revisions}
    assert got == {(1, 1): ["f"], (1, 2): ["h"], (1, 3): ["f"], (2, 1): ["f"], (2, 3): ["f"], (3, 1): ["f", "g"], (3, 3): ["f", "g"]}


def test_tokens_meet_their_rules_without_an_exchange_by_place(spark):
    """tokens with rules were grouped, sorted by place and joined with the tokens again."""
    tokens = spark.range(200).select((F.col("id") % 5).alias("work_id"), F.col("id").cast("int").alias("pos"), F.lit("x").alias("form"))
    assert exchanges(review.review_map(tokens, _rules(spark))) <= 2
    assert exchanges(review.review_exclude(tokens, _rules(spark))) <= 2


def test_cascade_of_words(spark):
    """the hits of a vocabulary are those of its tokens."""
    words = spark.createDataFrame([("cat", "cat", 1), ("cat's", "cat's", 2), ("dogs", "dog", 3), ("zzz", "zzz", 4)], "form string, lemma string, k int")
    lexicon = spark.createDataFrame([("cat",), ("dog",)], "form string")
    got = {r.form: (r.term, r.method, r.k) for r in matching.cascade_words(words, lexicon).collect()}
    assert got == {"cat": ("cat", "exact", 1), "cat's": ("cat", "possessive", 2), "dogs": ("dog", "lemma", 3), "zzz": (None, "unmatched", 4)}
    plain = {r.form: (r.term, r.method, r.k) for r in matching.match_cascade(words, lexicon).collect()}
    assert plain == got


SMALL = "/root/testdata/sf0.001"


def test_texts_are_dealt_before_they_fall_into_tokens(spark):
    """Tokens were dealt by work, each a row of the exchange."""
    from quire.plans import base

    for df in (base.form_counts(spark, SMALL), base.words(spark, SMALL).groupBy("work_id").count()):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    pos = lambda df: sorted(tuple(r) for r in df.select("work_id", "pos", "surface", "form").collect())
    assert pos(base.words(spark, SMALL)) == pos(base.plain_words(spark, SMALL))
    at = lambda df: sorted(tuple(r) for r in df.select("work_id", "line_no", "line_pos", "surface").collect())
    assert at(base.words(spark, SMALL)) == at(base.line_words(spark, SMALL))


def test_summary_of_counted_forms(spark):
    """a form counts as often as it stands in the work."""
    from quire.operators import scores

    rows = spark.createDataFrame([(1, "a", 3, 0.2), (1, "b", 1, 0.9), (1, "c", 2, None)], "work_id long, form string, n long, value double")
    r = scores.norm_summary(rows, 0.25, 0.75).first()
    assert (r.eligible, r.unrated, r.types, r.rated_types, r["count"], r.low, r.high, r.is_sparse) == (6, 2, 3, 2, 4, 3, 1, True)
    assert abs(r.mean - 0.375) < 1e-12 and abs(r.median - 0.2) < 1e-12 and abs(r.q3 - 0.375) < 1e-12


def test_tags_of_counted_spans(spark):
    """statistics by tag weigh a span by its number."""
    from quire.operators import scores

    rows = spark.createDataFrame([(1, ["NOUN"], 3, 0.2), (1, ["NOUN"], 1, 0.6), (1, ["ADP", "NOUN"], 2, 0.5), (1, ["ADP", "ADP"], 2, None)], "work_id long, tags array<string>, n long, v double")
    got = {r.tag: (r["count"], r.mean and round(r.mean, 9)) for r in scores.by_tag(rows, ["v"]).collect()}
    assert got == {"NOUN": (4, 0.3), "MIXED": (2, 0.5), "ADP": (0, None)}


def test_category_profiles_see_sums_only(spark):
    """each form went through up to six views; only sums by category do now."""
    from quire.operators import scores

    kind = "work_id long, form string, n long, is_stopword boolean, is_content boolean, intensities array<struct<category:string,value:double>>"
    rows = spark.createDataFrame([(1, "a", 3, False, True, [("joy", 0.5)]), (1, "b", 1, True, False, [("joy", 1.0), ("fear", 0.2)]), (1, "c", 4, False, False, None)], kind)
    df = scores.category_profiles(rows)
    got = {(r.scope, r.weighting, r.category): (r.matched, round(r.intensity, 9), r.eligible, r.proportion) for r in df.collect()}
    assert got[("all", "token", "joy")] == (4, 0.625, 8, 0.5) and got[("all", "type", "joy")] == (2, 0.75, 3, 2 / 3) and got[("all", "token", "fear")] == (1, 0.2, 8, 0.125)
    assert got[("content", "token", "joy")] == (3, 0.5, 3, 1.0) and got[("without_stopwords", "type", "joy")] == (1, 0.5, 2, 0.5) and len(got) == 8
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_unmatched_forms_are_counted_before_they_meet_the_table(spark):
    """the same as counting the matches."""
    rows = [(1, 1, 1, 1, "Zz", "zz"), (1, 2, 1, 2, "cat", "cat"), (1, 3, 2, 1, "zz", "zz"), (2, 1, 4, 1, "zz", "zz")]
    tokens = spark.createDataFrame(rows, "work_id long, pos int, line_no int, line_pos int, surface string, form string")
    known = spark.createDataFrame([("zz", None), ("cat", "cat")], "form string, term string")
    pick = lambda df: sorted(tuple(r) for r in df.select("work_id", "form", "frequency", "first_line", "example").collect())
    assert pick(matching.unmatched_forms(tokens, known)) == pick(matching.unmatched_terms(tokens.join(known, "form"))) == [(1, "zz", 2, 1, "Zz"), (2, "zz", 1, 4, "zz")]


def test_places_travel_with_their_form(spark):
    """a form of a work is one row of the exchange, whatever its number."""
    from quire.plans import base

    rows = spark.createDataFrame([(w, i % 4, i, "abc"[i % 3]) for w in (1, 2) for i in range(30)], "work_id long, line_no int, pos int, form string")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "form string, k int")
    pick = lambda df: sorted((r.work_id, r.line_no, r.pos, r.form, r.k or 0) for r in df.collect())
    assert pick(base.placed(rows, table, "line_no", "pos")) == pick(rows.join(table, "form", "left"))
    assert pick(base.placed(rows, table, "line_no", "pos", how="inner")) == pick(rows.join(table, "form"))


def test_sounds_are_counted_without_copies(spark):
    """distinct lines were counted beside the sounds, with every sound copied."""
    from quire.operators import phonology

    sounds = spark.createDataFrame([(1, 1, "vowel", "a"), (1, 1, "vowel", "a"), (1, 2, "vowel", "a"), (1, 2, "vowel", "e"), (1, 2, "consonant", "T")], "work_id long, line_no int, category string, sound string")
    df = phonology.sound_families(sounds)
    assert {(r.sound, r.n, r.lines, r.share) for r in df.collect()} == {("a", 3, 2, 0.75), ("e", 1, 1, 0.25), ("T", 1, 1, 1.0)}
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_units_without_evidence_need_no_join(spark):
    """a line without values stays, with count 0."""
    from quire.operators import statistics

    m = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.7)], "work_id long, line_no int, value double")
    df = statistics.by_structure(m, spark.createDataFrame([(1, 1), (1, 2)], "work_id long, line_no int"), "line_no")
    assert {(r.line_no, r["count"], r.minimum) for r in df.collect()} == {(1, 2, 0.5), (2, 0, None)}
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_types_of_counted_words(spark):
    """words are counted before they meet their pronunciation."""
    from quire.operators import phonology

    rows = spark.createDataFrame([("a", 5, "unique", "1", 1), ("b", 2, "unmatched", None, None)], "form string, n long, status string, stress string, syllables int")
    assert {(r.form, r.occurrences, r.stress) for r in phonology.pronounced_types(rows).collect()} == {("a", 5, "1"), ("b", 2, None)}
