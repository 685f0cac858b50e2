r"""Token ids in ORC files, ordered by document id.

Each document becomes one ORC row (doc_id, pos, n_tokens, ids).  ORC's integer columns use run-length encoding
(version 2: short repeats, deltas, patched base), each stripe holds row-index entries with minima and
maxima, and Bloom filters on doc_id let a lookup skip row groups and stripes.  Stripes can be read in
parallel.  ``pos`` is the position of the row: the number of its file's range partition in the upper
bits, its place in it in the lower 33, so ascending pos is ascending doc_id over all files.

The documents are range-partitioned by doc_id as text and encoded behind that shuffle: the ids, twice
as many bytes as the text here, cross no network, and sampling for the ranges doesn't tokenize.

Edge cases: null or empty text gives the end id alone.  The tokenizer's added tokens, written out in a text,
get their own ids, as in the library.  Rows with a null doc_id come first; rows with
equal ids are all kept, in an order fixed by a hash of the text.  An empty table writes no row.
Columns other than doc_id and text are not stored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import shuffle_width
from .chunks import Encoder, by_pieces

_HELD: dict[str, Encoder] = {}


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies show for each byte: itself where it prints, else the
    next unused one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _encoder(path: str) -> Encoder:
    """The worker's encoder for a byte-level tokenizer file, built once per Python worker.

    The library's model encodes each distinct piece.  Pieces that are letters, or letters and a mark,
    are cut here; any other chunk is cut by the library's own pre-tokenizer.  Texts that hold one of the
    tokenizer's added tokens, and texts of irregular white space, are encoded by the library whole.
    """
    if path not in _HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenize, cut = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str
        shown = byte_characters()
        added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

        def pieces(chunk: str) -> list[str]:
            return [chunk[a:b] for _, (a, b) in cut(chunk)]

        def ids(piece: str) -> list[int]:
            return [t.id for t in tokenize(piece.encode().decode("latin-1").translate(shown))]

        def whole(text: str) -> list[int]:
            return tokenizer.encode(text, add_special_tokens=False).ids

        _HELD.clear()
        [newline] = ids("\n")
        _HELD[path] = Encoder(by_pieces(pieces, ids, newline), whole, newline, added)
    return _HELD[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of every row, with the end id appended; keeps the rows' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            at = 0
            for flat, sizes in encoder.encode_column(batch.column("text")):
                ids = np.insert(flat, np.cumsum(sizes), end_id)
                ends = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(sizes)), pa.array(sizes + 1, pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])
                at += len(sizes)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>")


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, stripe_mb: int = 16, rows_per_index: int = 1000) -> None:
    """Encode ``docs`` and write the ORC folder ``out``."""
    n = shuffle_width(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    (
        encode_documents(ordered, tokenizer_path, end_id)
        .select("doc_id", F.monotonically_increasing_id().alias("pos"), "n_tokens", "ids")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(rows_per_index))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("compression", "zstd")
        .orc(out)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, pos, n_tokens, ids).  A list of ids becomes a filter that ORC's statistics and Bloom filters prune."""
    files = spark.read.schema("doc_id bigint, pos bigint, n_tokens bigint, ids array<int>").orc(path)
    return files if doc_ids is None else files.filter(F.col("doc_id").isin(doc_ids))


def describe_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, computed from the files.

    ``start`` is a two-level prefix sum: one small table of the sums of range partitions, and a window
    inside each partition; no task sees all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pos"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "pos", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path).mapInArrow(run, "doc_id bigint, pos bigint, n_tokens bigint, ids_crc32 bigint")
    rows = rows.withColumn("part", F.shiftright("pos", 33))
    inside = Window.partitionBy("part").orderBy("pos")
    rows = rows.withColumn("upto", F.sum("n_tokens").over(inside))
    parts = read_token_files(spark, path).groupBy(F.shiftright("pos", 33).alias("part")).agg(F.sum("n_tokens").alias("all"))  # reads no ids
    offsets = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    joined = rows.join(F.broadcast(offsets), "part")  # one row for each range partition, as many as shuffle partitions
    return joined.select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
