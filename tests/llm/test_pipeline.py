"""The pipeline's stages on a small table, each judged on its own input."""

import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from quire.llm.bpe import read_ranks


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 7)))
    texts = [" ".join(word() for _ in range(r.randint(60, 150))) for _ in range(40)]
    rows = [(i, t, "en", f"s{min(i % 7, 2)}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].upper(), "en", "s0", len(texts[i])) for i in range(5)]
    rows += [(200 + i, texts[10 + i] + " one more", "en", "s1", 0) for i in range(5)]
    rows += [(300, "too short", "en", "s0", 9), (301, None, None, None, None), (302, "same again " * 60, "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, d = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        seen[name] = [x.asDict() for x in d.collect()]
        if name != "byte-level BPE":
            assert d.columns == docs.columns
    ids = lambda name: sorted(x["doc_id"] for x in seen[name])
    assert ids("quality rules") == sorted([*range(40), *range(100, 105), *range(200, 205)])
    assert ids("exact dedup") == sorted([*range(5, 40), *range(100, 105), *range(200, 205)])
    assert ids("near dedup") == sorted([*range(5, 40), *range(100, 105)])
    assert set(ids("mixing")) == set(ids("near dedup")) and len(ids("mixing")) <= 2 * len(ids("near dedup"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {x["doc_id"]: x["text"] for x in seen["mixing"]}
    assert ids("byte-level BPE") == ids("mixing")
    for x in seen["byte-level BPE"]:
        assert x["n_tokens"] == len(library.encode_ordinary(texts[x["doc_id"]])) and x["decoded_sha256"] == hashlib.sha256(texts[x["doc_id"]].encode()).hexdigest()
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids("byte-level BPE")
