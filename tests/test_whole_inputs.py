"""Queries use the whole of their input: results of registered queries against plain computations."""

import hashlib

import numpy as np
import pytest

import __spark_entry__ as entry
from quire.plans import base

RNG = np.random.default_rng(11)


def embeddings(spark, folder, rows=230, size=12):
    """Vectors that differ only past their 8th element."""
    x = np.zeros((rows, size), np.float32)
    x[:, 8:] = RNG.normal(size=(rows, size - 8))
    spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return x.astype(float)


def test_embeddings_are_used_whole(spark, tmp_path):
    x = embeddings(spark, tmp_path)
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd <= 1e-12, 1, sd)
    assert {(r.id, r.feature): r.z for r in run("feature_standardise")} == {(i, str(k + 1)): pytest.approx(z[i, k], abs=2e-6) for i in range(len(x)) for k in range(12)}
    groups = np.arange(1, 13) % 7  # features have equal weight in a group, and groups among each other
    w = np.array([1 / 7 / (groups == g).sum() for g in groups])
    assert {r.id: (r.distance, r.features) for r in run("centre_distance")} == {i: (pytest.approx(np.sqrt((w * v * v).sum()), abs=2e-6), 12) for i, v in enumerate(z)}
    assert {(r.poet, r.feature): r.z for r in run("poet_centroids")} == {(p, str(k + 1)): pytest.approx(z[p::3, k].mean(), abs=2e-6) for p in range(3) for k in range(12)}
    assert len(run("feature_percentiles")) == x.size and len(run("corpus_feature_summary")) == 12
    near = {(r.id, r.place): r.other for r in run("nearest_works")}
    for i in (0, 100, 200):
        far = np.where(np.arange(len(x)) == i, np.inf, (w * (z - z[i]) ** 2).sum(axis=1))
        assert [near[i, k + 1] for k in range(10)] == list(np.argsort(far)[:10])
    _, singular, vt = np.linalg.svd(z * np.sqrt(w), full_matrices=False)
    loadings = vt[:2].T * np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(axis=1)])
    got = {(int(r.feature), r.component): (r.loading, r.explained) for r in run("weighted_pca")}
    assert got == {(i + 1, k + 1): (pytest.approx(loadings[i, k], abs=1e-4), pytest.approx(singular[k] ** 2 / (singular**2).sum(), abs=1e-5)) for i in range(12) for k in range(2)}
    points = (z * np.sqrt(w)) @ loadings
    assert {r.id: (r.pc1, r.pc2, r.weight) for r in run("project_points")} == {i: (pytest.approx(p[0], abs=1e-3), pytest.approx(p[1], abs=1e-3), pytest.approx(1)) for i, p in enumerate(points)}


def test_nearest_skips_nulls_and_asks_for_shared_weight(spark):
    from quire.operators import features

    r = np.random.default_rng(5)
    z = r.normal(size=(60, 8))
    z[r.random(z.shape) < 0.3] = np.nan
    w = list(features.feature_weights({str(i): f"g{i % 3}" for i in range(8)}).values())
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in x]) for i, x in enumerate(z)], "id long, z array<double>").repartition(3)
    got = {}
    for x in features.nearest(rows.filter("id < 7"), rows, w, n=4, block=3).collect():
        got.setdefault(x.id, []).append((x.place, x.other, round(x.distance, 6), round(x.shared_weight, 6)))
    for i in range(7):
        want = []
        for j in range(60):
            both = ~np.isnan(z[i]) & ~np.isnan(z[j])
            shared = sum(np.array(w)[both])
            if i != j and shared >= 0.6:
                want.append((round(float(np.sqrt((np.array(w)[both] * (z[i] - z[j])[both] ** 2).sum() / shared)), 9), j, shared))
        assert sorted(got.get(i, [])) == [(k + 1, j, round(d, 6), round(s, 6)) for k, (d, j, s) in enumerate(sorted(want)[:4])]


def test_a_changed_folder_is_read_anew(spark, tmp_path):
    """Tables kept for a session follow the files that they were made from."""
    write = lambda text: spark.createDataFrame([(1, text, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    write("alpha beta alpha")
    first = {r.lemma: r.tag for r in run("annotate_pos_lemma")}
    assert run("token_evidence_wide") and set(first) == {"alpha", "beta"}
    write("gamma delta")
    tags = {r.lemma: r.tag for r in run("annotate_pos_lemma")}
    again = {r.form: r for r in run("token_evidence_wide")}
    want = {w: base.TAGS[int(hashlib.md5(w.encode()).hexdigest()[13], 16) % 8] for w in ("gamma", "delta")}
    assert tags == want and {w: r.tag for w, r in again.items()} == want


ENGLISH_RULES = ["stopword_policy", "stopword_classify", "syllable_heuristic", "readability_counts", "readability_indices", "stopword_sensitivity", "scenario_deltas"]


def widened(name):
    """The query's SQL, as it is shipped: over words of any letters, and all documents but for English rules."""
    return entry.oracle_sql()[name]


@pytest.mark.parametrize("name", ["corpus_manifest", "corpus_issues", "tokens", "refrains", "six_profiles", "readability_counts", "stopword_policy"])
def test_documents_of_all_languages_are_used(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "the dark night\nthe dark night", "en"), (2, "l'été déjà passé\nà Noël", "fr"), (3, "schöne Grüße\nschöne Grüße", "de"), (4, "mañana no", "es"), (5, "no language", None)]
    spark.createDataFrame([(i, t, lang, "a", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(widened(name))
    heads = [d[0] for d in cursor.description]
    plain = lambda rows: sorted(tuple(str(round(x, 5) if isinstance(x, float) else x) for x in r) for r in rows)
    got = entry.queries()[name](spark, str(tmp_path)).select(*heads).collect()
    assert plain(got) == plain(cursor.fetchall())
    assert name in ENGLISH_RULES or name == "refrains" or {r.work_id for r in got} == {1, 2, 3, 4, 5}
