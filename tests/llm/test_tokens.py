"""BPE and token files against the tokenizer libraries, as round trips and on awkward texts."""

import base64
import hashlib
import random
import struct
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quire.llm.bpe import ByteBPE, bpe_roundtrip, read_ranks
from quire.llm.chunks import Encoder, by_pieces
from quire.llm.token_files import describe_token_files, read_token_files, write_token_files

RANKS = P.path("byte_bpe_50k.tiktoken")
AWKWARD = [
    "", " ", "  ", "a", " a", "a ", "hello world", "it's we'll 'S  x", "a  b", "a \n b", "\n\n a", "tab\tx y z 　w", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40,
    "日本語 テキスト 😀😀 👨‍👩‍👧 x", "1234567890 12 345.678e9", "<|endoftext|> x <|endoftext|>", "\x00\x01 \x1c x\x1fy", "éèê ça où", "x" * 3000 + " " * 500 + "y", "a\r\nb \r\n c",
]


def random_texts(n):
    r = random.Random(5)
    bits = ["a", "b", "the", " ", "  ", "\n", "'s", "ing", "é", "日", "😀", "12", "!", "\t", "_", "-", "tion", " "]
    return ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_columns_equal_single_texts():
    """Whole columns, in slices of any size and with a memory that overflows, give each text's own ids."""
    import numpy as np
    import pyarrow as pa

    texts = [*AWKWARD, None, *random_texts(400), "plain words, of a usual kind.\nAnd a second line"]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    own = ByteBPE(read_ranks(RANKS), P.PATTERN)
    find, ids_of = own.encoder.whole, library.encode_ordinary
    for limit, size in ((400_000, 8 << 20), (7, 300)):
        import regex

        encoder = Encoder(by_pieces(regex.compile(P.PATTERN).findall, ids_of, 198, limit), find, 198, limit=limit)
        got = [part for flat, n in encoder.encode_column(pa.array(texts, pa.string()), size) for part in np.split(flat, np.cumsum(n))[:-1]]
        assert [x.tolist() for x in got] == [library.encode_ordinary(t or "") for t in texts]


def test_encoding_equals_the_library():
    ranks = read_ranks(RANKS)
    own, library = ByteBPE(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in AWKWARD + random_texts(800):
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t), t
        assert own.decode(ids) == t.encode()


def test_encoding_backtracks_with_a_small_vocabulary():
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")} | {b"ab": 3, b"bc": 4, b"abc": 5, b"cab": 6, b"aa": 7, b"abab": 8}
    own, library = ByteBPE(ranks, r".+"), tiktoken.Encoding("small", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
        assert own.encode(t) == library.encode_ordinary(t), t


def test_roundtrip_rows(spark):
    texts = [*AWKWARD, None, "same", "same"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = bpe_roundtrip(docs, RANKS, P.PATTERN).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe_roundtrip(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_token_files(spark, tmp_path):
    texts = [*AWKWARD, None, *random_texts(300)]
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    docs = spark.createDataFrame([(i, texts[i], "x", 3) for i in order], "doc_id long, text string, ids string, pos int").repartition(3)
    out = str(tmp_path / "files")
    write_token_files(docs, P.path("byte_bpe_50k.json"), out)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))  # as it is: added tokens in a text keep their ids
    assert 50256 in library.encode(AWKWARD[15], add_special_tokens=False).ids
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = [*(library.encode(t, add_special_tokens=False).ids if t else []), 0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, describe_token_files(spark, out).collect())) == want
    assert [r.doc_id for r in read_token_files(spark, out, [5, 17]).orderBy("doc_id").collect()] == [5, 17]
    in_order = read_token_files(spark, out).orderBy("pos").select("doc_id").collect()
    assert [r[0] for r in in_order] == sorted(order)


def test_token_files_empty_null_and_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b"), (3, "x"), (3, "x"), (3, None)], "doc_id long, text string")
    write_token_files(docs, P.path("byte_bpe_50k.json"), str(tmp_path / "a"))
    rows = sorted(map(tuple, describe_token_files(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, 3, 3, 3] and [r[1] for r in rows][0] == 0 and sum(r[2] for r in rows) == 3 + 2 + 2 + 1
    write_token_files(docs.limit(0), P.path("byte_bpe_50k.json"), str(tmp_path / "b"))
    assert describe_token_files(spark, str(tmp_path / "b")).count() == 0


def test_bloom_filters_and_run_lengths_are_in_the_files(spark, tmp_path):
    import glob

    docs = spark.createDataFrame([(i, "word " * 200) for i in range(200)], "doc_id long, text string")
    write_token_files(docs, P.path("byte_bpe_50k.json"), str(tmp_path / "c"))
    data = b"".join(open(f, "rb").read() for f in glob.glob(str(tmp_path / "c" / "*.orc")))
    assert len(data) < 200 * 200  # a plain array would take 160,000 bytes
    assert len(data) > 0 and pytest.importorskip("pyarrow.orc")
