r"""Exact deduplication through an extendible-hash index kept in shared files.

Texts are normalised by lower-casing A-Z only and hashed; the first 8 bytes of the sha256 are the
pseudo-key.  The index is a directory over the key's leading bits and buckets of keys:

1. ``fingerprints``: one pass hashes each text; the small rows (doc_id, key, digest) are stored.
2. ``grow_directory``: starting with one bucket, buckets with more distinct keys than fit are split by
   one more bit, doubling the directory where a bucket already uses all its bits.  Equal keys count
   once, so a text with a million copies fills no bucket.  Splits follow counts made by Spark.
3. ``bucket_rows``: texts go to the bucket that the directory names for them.  Copies within a batch are
   compared byte by byte first and leave one row with their number and largest id, so a hot text sends
   one row a batch.
4. ``owner_groups``: the task that owns a key range takes its rows in key order, chains texts whose keys
   collide, compares bytes, and writes its part of the index to the shared folder: for each text its
   key, place in the chain, staying id and number of copies (and its bytes, where a chain has several).
5. Each document gets its group by its key, a small join.  Where a key has a chain of more than one
   text, and only there, the documents' texts are compared with those of the chain.

Edge cases: a null text equals the empty text.  Null ids take part and lose against any other.
Rows repeated with the same id are members like others: the group's size counts them all and all rows
with the staying id are kept.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shuffle_width, stored

_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MAX_DEPTH = 20


def normal_bytes(text: str | None) -> bytes:
    return text.encode().translate(_TO_LOWER) if text else b""


def key_of(digest: bytes, key_bits: int) -> int:
    """The leading ``key_bits`` of the digest as the upper bits of a signed 64-bit key."""
    top = int.from_bytes(digest[:8], "big") >> (64 - key_bits) << (64 - key_bits)
    return top - (1 << 64) if top >> 63 else top


def fingerprints(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(normal_bytes(t)).digest() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([key_of(d, key_bits) for d in digests], pa.int64()), pa.array(digests, pa.binary()), batch.column("print")], names=["doc_id", "key", "digest", "print"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("print")).mapInArrow(run, "doc_id bigint, key bigint, digest binary, print bigint")


def grow_directory(keys: DataFrame, capacity: int) -> np.ndarray:
    """Directory of 2**depth entries, each the number of its bucket.

    One Spark count of distinct keys at each depth; a number for each entry returns to the driver, at
    most 2**MAX_DEPTH of them.
    """
    directory, depth = np.zeros(1, np.int32), 0
    distinct = stored(keys.select("key").distinct(), "distinct-keys")
    while depth < MAX_DEPTH:
        entry = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0)
        counted = distinct.groupBy(entry.cast("int").alias("entry")).count().toArrow()
        filled = np.bincount(directory[np.asarray(counted["entry"])], np.asarray(counted["count"]), directory.max() + 1)
        overfull = np.flatnonzero(filled > capacity)
        if not len(overfull):
            break
        directory, depth = np.repeat(directory, 2), depth + 1
        for bucket in overfull:
            mine = np.flatnonzero(directory == bucket)
            directory[mine[len(mine) // 2 :]] = directory.max() + 1
    return directory


def bucket_rows(docs: DataFrame, directory: np.ndarray, key_bits: int = 64) -> DataFrame:
    """(bucket, key, norm, last_id, n): one row for each text and batch."""
    depth = len(directory).bit_length() - 1
    held = docs.sparkSession.sparkContext.broadcast(directory)  # at most 2**MAX_DEPTH entries of 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list] = {}  # a dict compares bytes where hashes agree
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                group = seen.setdefault(normal_bytes(text), [None, 0])
                group[1] += 1
                if group[0] is None or doc_id is not None and doc_id > group[0]:
                    group[0] = doc_id
            keys = [key_of(hashlib.sha256(norm).digest(), key_bits) for norm in seen]
            places = (np.array(keys, np.int64).astype(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(keys), np.int64)
            columns = [pa.array(held.value[places], pa.int32()), pa.array(keys, pa.int64()), pa.array(list(seen), pa.binary()), pa.array([g[0] for g in seen.values()], pa.int64()), pa.array([g[1] for g in seen.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "key", "norm", "last_id", "n"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "bucket int, key bigint, norm binary, last_id bigint, n bigint")


def owner_groups(rows: DataFrame) -> DataFrame:
    """(key, chain, keep_id, group_size, norm) of each distinct text; ``norm`` only in longer chains.

    Buckets are dealt to tasks whole.  A task streams its rows in key order and holds the chain of one
    key: the distinct texts that share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(key: int, chain: dict[bytes, list]) -> list[tuple]:
            many = len(chain) > 1
            return [(key, i, g[0], g[1], many, norm if many else None) for i, (norm, g) in enumerate(sorted(chain.items()))]

        key, chain = None, {}
        for batch in batches:
            out = []
            for k, norm, last_id, n in zip(*(batch.column(c).to_pylist() for c in ("key", "norm", "last_id", "n")), strict=True):
                if k != key:
                    if key is not None:
                        out += closed(key, chain)
                    key, chain = k, {}
                group = chain.setdefault(norm, [None, 0])
                group[1] += n
                if group[0] is None or last_id is not None and last_id > group[0]:
                    group[0] = last_id
            yield _rows(out)
        if key is not None:
            yield _rows(closed(key, chain))

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "key")
    return dealt.select("key", "norm", "last_id", "n").mapInArrow(run, "key bigint, chain int, keep_id bigint, group_size bigint, collides boolean, norm binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "chain", "keep_id", "group_size", "collides", "norm"])


def _grouped(docs: DataFrame, capacity: int, key_bits: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    prints = stored(fingerprints(docs, key_bits), "fingerprints")
    directory = grow_directory(prints, capacity)
    groups = stored(owner_groups(bucket_rows(docs, directory, key_bits)), "hash-index")
    columns = ["doc_id", "print", "digest", "keep_id", "group_size"]
    sole = groups.filter(~F.col("collides")).select("key", "keep_id", "group_size")
    # one row a key on the right; AQE can split a hot key's documents
    found = prints.join(sole.hint("shuffle_merge"), "key").select(*columns)
    chains = groups.filter("collides").select(F.col("norm").alias("chained"), "keep_id", "group_size")
    if not chains.isEmpty():
        norm = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary")
        lower = docs.select("doc_id", F.xxhash64("text").alias("print"), norm.alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
        found = found.unionByName(lower.join(chains.hint("shuffle_merge"), F.col("norm") == F.col("chained")).select(*columns))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("text_sha256", F.lower(F.hex("digest")))


def exact_groups(docs: DataFrame, capacity: int = 4096, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return _grouped(docs, capacity, key_bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(spark: SparkSession, docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text; of rows with the same id and text one stays."""
    kept = _grouped(docs, capacity, 64).filter("kept").groupBy("doc_id", "digest").agg(F.min("print").alias("print")).select("doc_id", "print")
    # a row travels as one column, so that no name of its own can clash
    d, k = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("print")).alias("d"), kept.hint("shuffle_merge").alias("k")
    stay = d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.print") == F.col("k.print")), "left_semi")
    return stay.dropDuplicates(["doc_id", "print"]).select("row.*")
