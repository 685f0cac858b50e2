"""Queries that gave a part of their rows: units, measures."""

from __future__ import annotations



def _documents(spark, tmp_path, texts):
    rows = [(i, "x", t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_norms_of_lines_and_of_stanzas(spark, tmp_path):
    """stanzas were left out.  Stanzas are runs of lines that aren't blank; a stanza without evidence stays with count 0."""
    from quire.catalogue import QUERIES
    from quire.plans import base

    texts = ["red sea wide\nno the red\n  \n\n\nsea sea\n\n...\n", "\n\none line", "", "wide no\nwide"]
    sf = _documents(spark, tmp_path, texts)
    score = {r.form: r.value for r in base.norms(spark, sf).collect()}
    stanzas = {0: [(1, [1, 2]), (2, [6]), (3, [8])], 1: [(1, [3])], 3: [(1, [1, 2])]}
    got = {(r.work_id, r.line_no, r.stanza_no): (r["count"], r["mean"], r.maximum) for r in QUERIES["norm_by_structure"](spark, sf).collect()}
    want = {}
    for w, text in enumerate(texts):
        lines = text.split("\n")[: -1 if text.endswith("\n") or not text else None]
        stats = lambda words: (len(v := [score[x] for x in words if x in score]), round(sum(v) / len(v), 6) if v else None, round(max(v), 6) if v else None)
        want |= {(w, i + 1, None): stats(line.split()) for i, line in enumerate(lines)}
        want |= {(w, None, n): stats([x for i in own for x in lines[i - 1].split()]) for n, own in stanzas.get(w, [])}
    assert score and got == want


def test_strength_and_exclusivity(spark):
    """They were left out; and a form of a work travelled with all of its scores."""
    from quire.operators import scores
    from quire.plans import base

    table = {"red": (3.0, 4.0, 1.0), "sea": (0.0, 0.0, 2.0), "no": (0.0, 0.0, 0.0)}
    works = spark.createDataFrame([(1, "Red red sea\n\nunknown no"), (2, "unknown"), (3, ""), (4, None)], "work_id long, text string")
    known = spark.createDataFrame([(f, *v) for f, v in table.items()], "form string, d1 double, d2 double, d3 double")
    df = scores.work_dimensions(works, known, ["d1", "d2", "d3"], {"two": slice(0, 2), "all": slice(0, 3)}, base.LETTERS)
    got = {(r.work_id, r.dimension): r for r in df.collect()}
    assert len(got) == 2 * 7 and {w for w, _ in got} == {1, 2}
    pick = lambda d: tuple(x if x is None else round(x, 9) for x in (got[1, d]["count"], got[1, d]["mean"], got[1, d].median, got[1, d].maximum, got[1, d].total, got[1, d].per_100))
    assert pick("two_strength") == (4, round(91 ** (1 / 3) / 2, 9), round(91 ** (1 / 3) / 2, 9), round(91 ** (1 / 3), 9), None, None)
    assert pick("all_exclusivity") == (3, round((3 / 8 * 2 + 1) / 3, 9), 0.375, 1.0, None, None) and pick("two_exclusivity")[0] == 2
    assert pick("d3") == (4, 1.0, 1.0, 2.0, 4.0, 80.0)
    counted = spark.createDataFrame([(1, 2, *table["red"]), (1, 1, *table["sea"]), (1, 1, *table["no"]), (1, 1, None, None, None), (2, 1, None, None, None)], "work_id long, n long, d1 double, d2 double, d3 double")
    for r in scores.dimension_stats(counted, ["d1", "d2", "d3"]).collect():
        own = got[r.work_id, r.dimension]
        assert all(own[c] == r[c] or abs(own[c] - r[c]) < 1e-12 for c in df.columns), (r, own)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in x and "work_id" in x for x in plan.splitlines())
