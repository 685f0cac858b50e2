"""Works whose mean is 0.5 in exact arithmetic, where the order of a sum of doubles decides."""

import hashlib
import random
from itertools import count

import pytest
from pyspark.sql import functions as F

from quire.operators import statistics


def _score(word: str) -> int | None:
    digits = hashlib.md5(word.encode()).hexdigest()
    return int(digits[:4], 16) if int(digits[4], 16) < 8 else None


@pytest.fixture(scope="module")
def tied():
    """Texts of listed words whose scores come to half of the most."""
    r = random.Random(7)
    words = {w: _score(w) for w in ("".join(r.choice("aeioubcdfglmnprst") for _ in range(7)) for _ in range(60_000))}
    listed = {w: k for w, k in words.items() if k is not None}
    by_score, names, texts = {k: w for w, k in listed.items()}, sorted(listed), []
    for _ in count():
        own = [r.choice(names) for _ in range(r.choice([7, 15, 31]))]
        last = by_score.get(65535 * (len(own) + 1) // 2 - sum(listed[w] for w in own))
        if last:
            texts.append([*own, last])
        if len(texts) == 80:
            return texts


def _relation(text):
    total = 0.0
    for w in text:
        total += _score(w) / 65535.0
    mean = total / len(text)
    return "above" if mean > 0.5 else "below" if mean < 0.5 else "at"


def test_ties_are_summed_up_as_the_text_runs(spark, tied, tmp_path):
    """the sum followed the order in which an exchange brought a work's forms."""
    from quire.catalogue import QUERIES

    rows = [(i, "x", " ".join(t), "en") for i, t in enumerate(tied)] + [(100, "x", "", "en"), (101, "x", tied[0][0], "en")]
    spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {r.work_id: r.relation for r in QUERIES["midpoint_relation"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: _relation(t) for i, t in enumerate(tied)} | {101: _relation(tied[0][:1])}
    assert len(set(got.values())) == 3


def test_ordered_means(spark):
    rows = spark.createDataFrame([(1, 2, 0.1), (1, 1, 1e16), (1, 3, -1e16), (1, 4, None), (2, 1, None)], "work_id long, pos int, value double")
    assert {(r.work_id, r["mean"]) for r in statistics.ordered_means(rows.repartition(3, F.col("pos"))).collect()} == {(1, (1e16 + 0.1 - 1e16) / 3)}
