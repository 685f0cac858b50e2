r"""Near-duplicate groups by MinHash with tensored banding.

A document's set is its distinct shingles of ``size`` words (A-Z lower-cased).  ``parts`` small
collections of ``width`` minhashes each are computed; the key of a table combines a pair of them, so
``parts`` * ``width`` minhashes serve parts * (parts - 1) / 2 tables, about a square root of what as many
independent bands of 2 * width would take.  With 16 collections of 3, two sets of similarity 0.8 miss
all 120 tables with a probability of 0.0002, and of 0.85 with 0.00001.

Documents with equal sets are one class from the start.  Classes that share a table key are candidates,
and a link counts only if the full sets confirm it.  Skipping pairs that are connected already changes no
component, so links are looked for in three steps, each on what the one before has left apart:

1. each class and the centre that it shares most buckets with (a bucket's centre is its least class, found by
   partial minima before the shuffle, so a bucket of any size reaches its reducer as a row a task);
2. all pairs of a bucket of at most ``small`` classes, and each class and the centre in a larger one;
3. the classes of larger buckets that are still not one component: an exact set-similarity join of
   their full sets (``setjoin``), whose rarest-first prefixes don't meet on the passage that brought
   dissimilar texts into one bucket.

So no bucket is expanded into all its pairs, and there is no cap on buckets or candidates.  Joins on keys
have one row a key on one side, and adaptive execution splits a hot key on the other.

Before full sets travel, parities are compared: each set carries, for each of ``PARITIES`` groups of shingles,
whether it has an odd number of them.  Two sets differ in at least as many shingles as groups, so the groups
in which they differ rule out, without error, most pairs below the limit that meet because they share a
long passage.  Sets of several thousand shingles fill all groups and are verified in full instead.

Edge cases: a text without words (or null) has no set, links with nothing and stays.  Fewer words than
``size`` make one shingle.  Rows with the same id and set belong to one class, and all rows with a
component's least id are kept; null ids never name a component unless it has no other.  ``drop_near_copies``
keeps one row of each component, the first by id and text, and of rows that agree in both one.  Extra
columns are ignored, or carried by ``drop_near_copies``.  Classes are named by 64 bits of the set's 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setjoin
from ._shared import drop_stored, shuffle_width, stored
from .components import components
from .hashing import hashed_words, mix, shingles, signed

#: Groups of shingles whose parities a set carries, 64 in a column.
PARITIES = 1024
_COLUMNS = [f"p{i}" for i in range(PARITIES // 64)]


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, bounds, starts, hashes in hashed_words(texts):
        at = np.searchsorted(starts, bounds)
        for a, b in zip(at, at[1:]):
            yield shingles(hashes[a:b], size)


def _multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


def minhashes(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(values), 2048):
        np.minimum(least, (values[None, lo : lo + 2048] * multipliers[:, None]).min(axis=1), out=least)
    return least


def _printed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("print"))


def document_sets(docs: DataFrame, size: int, parts: int, width: int, seed: int) -> DataFrame:
    """doc_id, v (class), n_shingles and the keys of the small collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(parts * width, seed)
        for batch in batches:
            v, n, keys = [], [], []
            for s in _sets(batch.column("text"), size):
                n.append(len(s))
                if not len(s):
                    v.append(None)
                    keys.append(None)
                    continue
                v.append(xxhash.xxh3_128_intdigest(s.tobytes()) >> 64)
                least = minhashes(s, multipliers).reshape(parts, width)
                key = np.arange(parts, dtype=np.uint64)
                for k in range(width):
                    key = mix(key * np.uint64(31) + least[:, k])
                keys.append(signed(key))
            ids = pa.array([None if x is None else x - (1 << 64) * (x >> 63) for x in v], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), batch.column("print")], names=["doc_id", "v", "n_shingles", "keys", "print"])

    return _printed(docs).mapInArrow(run, "doc_id bigint, v bigint, n_shingles bigint, keys array<bigint>, print bigint")


def _table_rows(classes: DataFrame, parts: int) -> DataFrame:
    """(key, v): a row for each class and table, the key combined from a pair of collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = (np.array(x) for x in zip(*combinations(range(parts), 2)))
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                keys = np.asarray(batch.column("keys").flatten()).reshape(-1, parts).view(np.uint64)
                paired = mix(mix(keys[:, left]) + keys[:, right] * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(signed(paired.ravel())), pa.array(np.repeat(np.asarray(batch.column("v")), len(left)))], names=["key", "v"])

    return classes.select("keys", "v").mapInArrow(run, "key bigint, v bigint")


def _parities(values: np.ndarray) -> list[int]:
    odd = np.bincount((mix(values) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _full_sets(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """(v, set, parities): the set of each class in ``chosen`` (doc_id, print, v), its hashes packed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                sets = list(_sets(batch.column("text").slice(lo, 500), size))
                v = [xxhash.xxh3_128_intdigest(s.tobytes()) >> 64 for s in sets]
                v = pa.array([x - (1 << 64) * (x >> 63) for x in v], pa.int64())
                yield pa.RecordBatch.from_arrays([v, batch.column("v").slice(lo, 500), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_parities(s) for s in sets], pa.list_(pa.int64()))], names=["v", "want", "set", "parities"])

    d, c = _printed(docs).alias("d"), chosen.alias("c")
    named = d.join(c.hint("shuffle_merge"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.print") == F.col("c.print"))).select("c.v", "d.text")
    return named.mapInArrow(run, "v bigint, want bigint, set binary, parities array<bigint>").filter("v = want").drop("want").dropDuplicates(["v"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, held = [], None, None
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if a != last:
                    last, held = a, np.frombuffer(x.as_buffer(), np.uint64)
                other = np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(held) + len(other) - len(np.union1d(held, other)) if len(held) < 64 else int(_shared_count(held, other))
                keep.append(100 * shared >= percent * (len(held) + len(other) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    x, y = sets.select(F.col("v").alias("a"), F.col("set").alias("x")), sets.select(F.col("v").alias("b"), F.col("set").alias("y"))
    both = pairs.join(y.hint("shuffle_merge"), "b").join(x.hint("shuffle_merge"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _shared_count(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return np.count_nonzero(a[at] == b)


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether the sizes and parities of two rows, their columns prefixed by ``x`` and ``y``, allow the similarity."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    differ = reduce(add, [F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in _COLUMNS])
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _side(rows: DataFrame, x: str, *keep: str) -> DataFrame:
    return rows.select(*keep, *[F.col(c).alias(x + c) for c in rows.columns if c not in keep])


def _apart(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose sizes and parities allow the similarity.  ``sizes``: v, n, parities."""
    side = lambda x: _side(sizes.withColumnRenamed("v", x), x, x).hint("shuffle_merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_possible("a", "b", percent)).select("a", "b")


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the label of v: its component so far."""
    if labels is None:
        return rows.withColumn("label", F.col("v"))
    return rows.join(labels.hint("shuffle_merge"), "v", "left").withColumn("label", F.coalesce("root", "v")).drop("root")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that have more than one label."""
    several = rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    return rows.join(several.select("key").hint("shuffle_merge"), "key")


def _components(docs: DataFrame, size: int, percent: int, parts: int, width: int, seed: int, small: int) -> DataFrame:
    """doc_id, print, n_shingles, root of every row; no root where there is no set."""
    members = stored(document_sets(docs, size, parts, width, seed), "sets")
    classes = members.filter("v is not null").groupBy("v").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.min(F.struct("doc_id", "print")).alias("at"))

    # dealt anew: adaptive execution makes few partitions of the small classes, and each becomes many rows here
    rows = _table_rows(classes.repartition(shuffle_width(docs.sparkSession), "v"), parts).select("key", "v")
    buckets = rows.groupBy("key").agg(F.count("*").alias("many"), F.min("v").alias("centre")).filter("many > 1")
    rows = stored(rows.join(buckets.hint("shuffle_merge"), "key"), "buckets")
    chosen = classes.select("v", "at.doc_id", "at.print").join(rows.select("v").distinct().hint("shuffle_merge"), "v", "left_semi")
    sets = stored(_full_sets(docs, chosen, size), "full-sets")
    sizes = sets.select("v", (F.octet_length("set") / 8).cast("int").alias("n"), *[F.col("parities")[i].alias(c) for i, c in enumerate(_COLUMNS)])

    def merged(pairs: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        possible = stored(_apart(pairs, sizes, percent), "pairs")
        return labels if possible.isEmpty() else _merged(labels, stored(_confirmed(possible, sets, percent), "confirmed"))

    counted = rows.filter("v <> centre").groupBy("v", "centre").agg(F.count("*").alias("keys"))
    best = counted.groupBy("v").agg(F.max_by("centre", F.struct("keys", "centre")).alias("centre"))
    labels = merged(_pairs(best, "v", "centre"), None)

    mixed = stored(_mixed(_labelled(rows, labels)), "mixed")
    few, many = mixed.filter(F.col("many") <= small), mixed.filter(F.col("many") > small)
    few = stored(few.select("key", "v", "label").join(sizes.hint("shuffle_merge"), "v"), "few")
    within = _side(few, "x", "key").hint("shuffle_merge").join(_side(few, "y", "key"), "key")
    within = within.filter((F.col("xv") < F.col("yv")) & (F.col("xlabel") != F.col("ylabel")) & _possible("x", "y", percent)).select(F.col("xv").alias("a"), F.col("yv").alias("b"))
    centres = many.filter("v = centre").select("key", F.col("label").alias("lc"))
    to_centre = _pairs(many.join(centres.hint("shuffle_merge"), "key").filter("label <> lc"), "v", "centre")
    labels = merged(within.union(to_centre).distinct(), labels)

    left = stored(_mixed(_labelled(many.drop("label"), labels)).select("v", "label").distinct(), "left")
    if not left.isEmpty():
        held = sets.select("v", "set").join(left.select("v").hint("shuffle_merge"), "v", "left_semi")
        counts = setjoin.collected_counts(setjoin.word_counts(held, setjoin.read_packed, 1 << 22), 1 << 22)
        exact = setjoin.Join(held, setjoin.read_packed, counts, percent, common=1 << 31)
        labels = merged(exact.candidates(exact.prefixes(), left), labels)

    roots = labels if labels is not None else members.limit(0).select("v", F.col("v").alias("root"))
    named = members.join(roots.hint("shuffle_merge"), "v", "left").select("doc_id", "print", "n_shingles", F.coalesce("root", "v").alias("root"))
    named = stored(named, "named")
    for table in (rows, sets, mixed, few, members):
        drop_stored(table)
    return named


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, parts: int = 16, width: int = 3, seed: int = 11, small: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    named = _components(docs, size, percent, parts, width, seed, small)
    least = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    whole = named.join(least.hint("shuffle_merge"), "root", "left")
    component = F.coalesce("component_id", "doc_id")
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components (v, root) of ``labels`` joined by further links between their members."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    root = lambda end: labels.select(F.col("v").alias(end), F.col("root").alias("r" + end)).hint("shuffle_merge")
    between = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    joined = components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    moved = labels.join(joined.select(F.col("v").alias("root"), F.col("root").alias("to")).hint("shuffle_merge"), "root", "left")
    new = joined.join(labels.select("v").hint("shuffle_merge"), "v", "left_anti")
    return stored(moved.select("v", F.coalesce("to", "root").alias("root")).union(new.select("v", "root")), "labels")


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, **settings) -> DataFrame:
    """The rows of ``docs`` that stay, one for each component and for each text without a set."""
    named = _components(docs, size, percent, **({"parts": 16, "width": 3, "seed": 11, "small": 32} | settings))
    first = named.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("at"))
    kept = first.select("at.doc_id", "at.print").union(named.filter("root is null").select("doc_id", "print").distinct())
    # a row travels as one column, so that no name of its own can clash
    d, k = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("print")).alias("d"), kept.hint("shuffle_merge").alias("k")
    stay = d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.print") == F.col("k.print")), "left_semi")
    return stay.dropDuplicates(["doc_id", "print"]).select("row.*")
