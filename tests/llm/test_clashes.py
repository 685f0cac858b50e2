"""Every stage that returns documents carries columns of any name."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm.line_dedup import without_repeated_lines

NAMES = ["_print", "print", "_touched", "touched", "_cut", "cut", "_lines", "lines", "_links", "links", "row", "rows", "uses", "use", "_use", "p", "q", "key", "v", "kept", "keep_id", "hash", "line", "n", "source2", "host", "digest", "d", "k", "c", "root", "weight", "block"]


@pytest.fixture(scope="module")
def docs(spark):
    text = "\n".join(" ".join(f"w{(i * 7 + j) % 50}" for j in range(20)) for i in range(6))
    rows = [(i, text if i < 3 else f"other {i} " + " ".join(f"x{i}y{j}" for j in range(80)), "en", f"s{i % 2}", 5) for i in range(8)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return made.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, docs, name):
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in NAMES)


def test_line_dedup(docs):
    found = without_repeated_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed", "n_links"]
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[1].n_removed == 6 and all(r[n] == f"{n}-{i}" for i, r in rows.items() for n in NAMES)


def test_encoding(spark, docs):
    assert dict(corpus_pipeline.STAGES)["byte-level BPE"](spark, docs, "").count() == 8
