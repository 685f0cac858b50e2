r"""Exact set-similarity join on sets of words: rarity order, prefix, length and positional filters.

A set is named by a 64-bit class ``v``; equal sets are one class.  Words are put in one global order,
rarest first, by counts over all sets (hashed to ``slots`` counters; any fixed order is exact, a
rare-first one is fast).  Two sets as similar as ``percent`` share a word of their prefixes, the first
n - ceil(percent * n) + 1 words of n, and every such pair has a first shared word, in the prefixes of both.
Its count says where the pair is found, so that no pair is found twice:

* words in at most ``common`` sets are join keys.  Pairs that meet on one must pass the length filter, the
  positional filter (from the first shared word on, both have enough words left for the overlap) and a parity
  filter (each set carries the parities of its words in 64 groups, a larger one in 128 or 256; two sets
  differ in at least as many words as groups), and the pairs that remain are verified on the full sets;
* the sets with a word in more sets in their prefix are counted for each such word, which are often few, and
  dealt in blocks of about ``block`` sets.  A task holds two blocks of one word, works out the overlaps of
  all its pairs at once and returns a sum for each set, never the pairs.

A prefix word that stands in one set of the corpus can't be shared and isn't emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shuffle_width, stored
from .hashing import mix, signed

#: Words are 48-bit hashes, so that (place of the set, word) sorts as one number.
WORD_BITS = np.uint64(48)
_LOW = (np.uint64(1) << WORD_BITS) - np.uint64(1)
_32, _16, _SALT = np.uint64(32), np.uint64(16), np.uint64(0x5851F42D4C957F2D)
MOST_SETS = 1 << 16
#: Words from which a set carries 128 and 256 parities.
WIDE, WIDER = 64, 192
MOST_COUNT = (1 << 32) - 1


class Sets(NamedTuple):
    """At most MOST_SETS sets, one after the other."""

    v: np.ndarray  # class names, int64
    n: np.ndarray
    first: np.ndarray  # where a set starts in ``words``
    words: np.ndarray  # ascending in each set


def sets_of(place: np.ndarray, hashes: np.ndarray) -> Sets:
    """Distinct words of each place; places ascend from 0 and each has a word."""
    keyed = np.sort(place.astype(np.uint64) << WORD_BITS | hashes >> _16)
    keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
    at, words = (keyed >> WORD_BITS).astype(np.int64), keyed & _LOW
    first = np.flatnonzero(np.diff(at, prepend=-1))
    n = np.diff(np.append(first, len(at)))
    name = mix(np.add.reduceat(mix(words ^ _SALT), first) + n.astype(np.uint64))
    return Sets(signed(name), n, first, words)


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def all_parities(sets: Sets) -> np.ndarray:
    """[set, 4]: whether each of 256 groups holds an odd number of its words."""
    bit, part = np.uint64(1) << (sets.words >> np.uint64(40) & np.uint64(63)), sets.words >> np.uint64(46)
    return np.stack([np.bitwise_xor.reduceat(np.where(part == np.uint64(k), bit, np.uint64(0)), sets.first) for k in range(4)], axis=1)


def parities(sets: Sets) -> list[np.ndarray]:
    """Whether each of 256 groups holds an odd number of a set's words, as four integers.  The groups of a
    smaller set are folded to 128 or 64, in the first two integers or the first."""
    q = all_parities(sets).T
    none, wide, wider = np.uint64(0), sets.n >= WIDE, sets.n >= WIDER
    low, up = q[0] ^ q[2], q[1] ^ q[3]
    return [np.where(wider, q[0], np.where(wide, low, low ^ up)), np.where(wider, q[1], np.where(wide, up, none)), np.where(wider, q[2], none), np.where(wider, q[3], none)]


#: Groups in which the sets of two rows a and b differ, in SQL.
_DIFFER = f"""if(na >= {WIDER} and nb >= {WIDER}, bit_count(a0 ^ b0) + bit_count(a1 ^ b1) + bit_count(a2 ^ b2) + bit_count(a3 ^ b3),
if(na >= {WIDE} and nb >= {WIDE}, bit_count(a0 ^ a2 ^ b0 ^ b2) + bit_count(a1 ^ a3 ^ b1 ^ b3), bit_count(a0 ^ a1 ^ a2 ^ a3 ^ b0 ^ b1 ^ b2 ^ b3)))"""


def word_counts(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Sets]], slots: int) -> DataFrame:
    """(block, counts): how many sets of ``rows`` hold a word, in hashed slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            for sets in read(batch):
                count_into(total, sets.words)
        yield packed_counts(total)

    return summed_counts(rows.mapInArrow(run, "block int, counts binary"), slots)


BLOCK_SLOTS = 1 << 12


def count_into(total: np.ndarray, words: np.ndarray) -> None:
    slot, n = np.unique((words % np.uint64(len(total))).astype(np.uint32), return_counts=True)
    total[slot] += n.astype(np.uint32)


def packed_counts(total: np.ndarray) -> pa.RecordBatch:
    """(block, counts) of one task: the used slots of each block and their counts, packed."""
    used = np.flatnonzero(total).astype(np.uint32)
    cuts = np.searchsorted(used, np.arange(0, len(total) + 1, BLOCK_SLOTS))
    packed = [np.concatenate([used[a:b] % BLOCK_SLOTS, total[used[a:b]]]).astype(np.uint32).tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed), dtype=np.int32)), pa.array(packed, pa.binary())], names=["block", "counts"])


def summed_counts(packed: DataFrame, slots: int) -> DataFrame:
    """Sums of ``packed_counts`` over tasks: (block, counts as unsigned 64-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                pairs = np.frombuffer(x.as_buffer(), np.uint32).reshape(2, -1)
                held.setdefault(block, np.zeros(BLOCK_SLOTS, np.uint64))[pairs[0]] += pairs[1]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "counts"])

    return packed.repartition(shuffle_width(packed.sparkSession), "block").mapInArrow(run, "block int, counts binary")


def collected_counts(summed: DataFrame, slots: int) -> np.ndarray:
    """``slots`` counters, 8 bytes each, whatever the corpus."""
    found = np.zeros(slots, np.uint64)
    got = summed.toArrow()
    for block, x in zip(got["block"].to_pylist(), got["counts"].to_pylist(), strict=True):
        found[block * BLOCK_SLOTS : (block + 1) * BLOCK_SLOTS] = np.frombuffer(x, np.uint64)
    return found


_PREFIX = ["key", "v", "shape", "q0", "q1", "q2", "q3"]


class Join:
    """One join: ``read`` gives the sets of a batch of ``rows``, ``counts`` the counters of all words."""

    def __init__(self, rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Sets]], counts: np.ndarray, percent: int = 80, common: int = 256, block: int = 1024):
        self.rows, self.read, self.percent, self.common, self.block = rows, read, percent, common, block
        self.counts = rows.sparkSession.sparkContext.broadcast(np.minimum(counts, MOST_COUNT).astype(np.uint32))

    def _emitted(self, schema: str, make: Callable) -> DataFrame:
        """``make`` of the prefix words of each class that a task meets first: its sets, all of them and those
        met first, and each such word's place in ``words`` and in the order, its count and its set."""
        read, shared, percent = self.read, self.counts, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, seen = shared.value, set()
            for batch in batches:
                for sets in read(batch):
                    names, once = np.unique(sets.v, return_index=True)
                    fresh = np.zeros(len(sets.v), bool)
                    fresh[once] = [x not in seen for x in names.tolist()]  # saves rows; other tasks may send the same
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.update(names.tolist())
                    line = np.repeat(np.arange(len(sets.n)), sets.n)
                    count = counts[(sets.words % np.uint64(len(counts))).astype(np.int64)]
                    rank = np.sort(line.astype(np.uint64) << WORD_BITS | np.minimum(count, 65535).astype(np.uint64) << _32 | np.arange(len(line), dtype=np.uint64))
                    order = (rank & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    place = np.arange(len(line)) - np.repeat(sets.first, sets.n)
                    count = count[order]
                    taken = (place < np.repeat(prefix_length(sets.n, percent), sets.n)) & fresh[line] & (count > 1)
                    yield from make(sets, fresh, order[taken], place[taken], count[taken], line[taken])

        return self.rows.mapInArrow(run, schema)

    def prefixes(self) -> DataFrame:
        """(key, v, shape, q0 to q3): a row for each prefix word of few sets and class; ``shape`` has the set's size
        and the word's place, q0 to q3 the set's parities."""
        limit = self.common

        def make(sets: Sets, fresh, word, place, count, line) -> Iterator[pa.RecordBatch]:
            few = count <= limit
            word, place, line = word[few], place[few], line[few]
            shape = sets.n[line].astype(np.int64) << 32 | place
            columns = [signed(mix(sets.words[word])), sets.v[line], shape, *(signed(q)[line] for q in parities(sets))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=_PREFIX)

        return self._emitted(", ".join(f"{c} bigint" for c in _PREFIX), make)

    def sets_and_members(self, wanted: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """(word, v, set) in one pass: with no word, the sets of classes that ``wanted`` names; with a word of more than
        ``common`` sets, the sets that have it in their prefix."""
        limit = self.common

        def packed(sets: Sets, at: np.ndarray) -> pa.Array:
            return pa.array([sets.words[a : a + n].tobytes() for a, n in zip(sets.first[at].tolist(), sets.n[at].tolist())], pa.binary())

        def make(sets: Sets, fresh, word, place, count, line) -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(fresh)
            at = at[wanted(sets.v[at])]
            many = count > limit
            rows = np.concatenate([at, line[many]])
            words = pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(signed(sets.words[word[many]]))])
            for lo in range(0, len(rows), 20_000):
                some = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays([words.slice(lo, 20_000), pa.array(sets.v[rows[some]]), packed(sets, rows[some])], names=["word", "v", "set"])

        return self._emitted("word bigint, v bigint, set binary", make)

    # --- words that few sets hold -------------------------------------------------------------------

    def candidates(self, prefixes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """Distinct pairs (a, b) that pass the filters on a word of few sets; with ``labels`` (v, label), of
        classes that are in it and differ in their label.  Words of one label alone are left out first."""
        # one shuffle serves both sides of the join; rows of a class that several tasks sent become one on a side
        rows = prefixes.repartition(shuffle_width(self.rows.sparkSession), "key")
        if labels is not None:
            rows = stored(rows.join(labels.select("v", "label").hint("shuffle_merge"), "v"), "labelled-prefixes")
            several = rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
            rows = rows.join(several.select("key").hint("shuffle_merge"), "key", "left_semi")
        else:
            rows = rows.withColumn("label", F.lit(None).cast("bigint"))

        def side(rows: DataFrame, x: str) -> DataFrame:
            size, place = F.shiftright("shape", 32), F.col("shape").bitwiseAND((1 << 32) - 1)
            return rows.select("key", F.col("v").alias(x), size.alias("n" + x), place.alias("p" + x), *[F.col(f"q{k}").alias(f"{x}{k}") for k in range(4)], F.col("label").alias("l" + x))

        percent, n = self.percent, F.col("na") + F.col("nb")
        ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
        overlap = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
        reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # a similar pair passes at its first shared word
        differ = F.expr(_DIFFER)
        met = side(rows.distinct(), "a").hint("shuffle_merge").join(side(rows, "b"), "key")
        if labels is not None:
            met = met.filter(F.col("la") != F.col("lb"))
        met = met.filter(ordered & (100 * F.col("na") >= percent * F.col("nb")) & (differ + 2 * overlap <= n) & (reach >= overlap))
        return met.select("a", "b").distinct()

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) of ``pairs`` that are similar and whose first shared word is one of few sets.
        ``sets``: v, set (words of 8 bytes, ascending), a row a class."""
        shared, percent, limit = self.counts, self.percent, self.common

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = shared.value
            for batch in batches:
                keep, last, held = [], None, None
                for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                    if a != last:
                        last, held = a, np.frombuffer(x.as_buffer(), np.uint64)
                    other = np.frombuffer(y.as_buffer(), np.uint64)
                    both = common_words(held, other)
                    similar = 100 * len(both) >= percent * (len(held) + len(other) - len(both))
                    keep.append(similar and int(counts[(both % np.uint64(len(counts))).astype(np.int64)].min()) <= limit)
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

        x, y = sets.select(F.col("v").alias("a"), F.col("set").alias("x")), sets.select(F.col("v").alias("b"), F.col("set").alias("y"))
        return pairs.join(y.hint("shuffle_merge"), "b").join(x.hint("shuffle_merge"), "a").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")

    # --- words that many sets hold ------------------------------------------------------------------

    def block_links(self, members: DataFrame) -> DataFrame:
        """(v, degree, doc_id, print, line_no) of ``members`` (word, v, set, and the set's first place): how many others a set
        is linked with by a word first, in two blocks of it, and the earliest place of them; a row for each."""
        shared, percent, size = self.counts, self.percent, self.block
        # a word's members are counted before they are dealt; adaptive execution splits a hot word in this join
        blocks = members.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
        dealt = members.join(blocks.hint("shuffle_merge"), "word").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("word", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "set", "doc_id", "print", "line_no")
        dealt = dealt.repartition(shuffle_width(members.sparkSession), "word", "i", "j").sortWithinPartitions("word", "i", "j")

        def links(group: pa.RecordBatch) -> dict[str, np.ndarray | pa.Array]:
            _, once = np.unique(group.column("v").to_numpy(), return_index=True)
            group = group.take(pa.array(once))
            names, own = group.column("v").to_numpy(), group.column("own").to_numpy()
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
            n = np.array([len(x) for x in parts])
            word, i, j = (group.column(c)[0].as_py() for c in ("word", "i", "j"))
            counts = shared.value
            count = lambda words: counts[(words % np.uint64(len(counts))).astype(np.int64)].astype(np.int64)
            a, b = linked(Sets(names, n, np.cumsum(n) - n, np.concatenate(parts)), np.uint64(word), count, percent)
            if i != j:
                a, b = a[own[a] != own[b]], b[own[a] != own[b]]
            if not len(a):
                return {}
            doc, text, line = (group.column(c) for c in ("doc_id", "print", "line_no"))
            order = np.lexsort((line.to_numpy(), text.to_numpy(), doc.fill_null(0).to_numpy(), np.asarray(doc.is_valid())))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ends, others = np.concatenate([a, b]), np.concatenate([b, a])
            degree, least = np.bincount(ends, minlength=len(names)), np.full(len(names), len(names))
            np.minimum.at(least, ends, rank[others])
            some = np.flatnonzero(degree)
            at = pa.array(order[least[some]])
            return {"v": pa.array(names[some]), "degree": pa.array(degree[some].astype(np.int64)), "doc_id": doc.take(at), "print": text.take(at), "line_no": line.take(at)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []  # of one word and pair of blocks, about two blocks of rows

            def closed() -> Iterator[pa.RecordBatch]:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
                if whole.num_rows > 1 and (found := links(whole)):
                    yield pa.RecordBatch.from_pydict(found)

            last = None
            for batch in batches:
                keys = [batch.column(c).to_numpy() for c in ("word", "i", "j")]
                change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
                cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi:
                        continue
                    key = tuple(k[lo] for k in keys)
                    if key != last:
                        if held:
                            yield from closed()
                        held, last = [], key
                    held.append(batch.slice(lo, hi - lo))
            if held:
                yield from closed()

        return dealt.mapInArrow(run, "v bigint, degree bigint, doc_id bigint, print bigint, line_no int")


def read_packed(batch: pa.RecordBatch, at_once: int = 1000) -> Iterator[Sets]:
    """The sets of a batch with columns v and set; ``set`` holds ascending 64-bit hashes, 8 bytes each."""
    for lo in range(0, batch.num_rows, at_once):
        part = batch.slice(lo, at_once)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) >> _16 for x in part.column("set")]
        n = np.array([len(s) for s in sets])
        yield Sets(part.column("v").to_numpy(), n, np.cumsum(n) - n, np.concatenate(sets) if sets else np.zeros(0, np.uint64))


def common_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The words that two ascending sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return a[b[at] == a]


def linked(sets: Sets, word: np.uint64, count, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of similar sets that share no word before ``word`` in the order.

    Sets are met in the order of their sizes, a few rows at a time with those that the size allows; parities rule
    out most pairs.  The rest are worked out one by one, or where they are many, as in a group of near
    copies, by products of incidence matrices.
    """
    m, n = len(sets.n), sets.n.astype(np.int64)
    order = np.argsort(n, kind="stable")
    size, parity = n[order], all_parities(sets)[order]
    upto = np.searchsorted(100 * size, 100 * (100 * size // percent) + 99, "right")
    some: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, m, 128):
        hi = min(m, lo + 128)
        end = upto[hi - 1]
        differ = np.zeros((hi - lo, end - lo), np.uint16)
        for k in range(parity.shape[1]):
            differ += np.bitwise_count(parity[lo:hi, k, None] ^ parity[None, lo:end, k])
        x, y = np.nonzero((100 + percent) * differ.astype(np.int32) <= (100 - percent) * (size[lo:hi, None] + size[None, lo:end]))
        later = y > x
        some.append((order[x[later] + lo], order[y[later] + lo]))
    i, j = (np.concatenate([p[k] for p in some]) if some else np.zeros(0, np.int64) for k in (0, 1))
    if not len(i):
        return i, j
    rank = np.minimum(count(sets.words), 65535) << 48 | sets.words.astype(np.int64)  # the words' order
    own = int(min(int(count(np.array([word], np.uint64))[0]), 65535) << 48 | int(word))
    if len(i) <= 20 * m:
        keep = np.zeros(len(i), bool)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            x, y = (slice(sets.first[z], sets.first[z] + sets.n[z]) for z in (a, b))
            both = np.intersect1d(rank[x], rank[y], assume_unique=True)
            keep[k] = 100 * len(both) >= percent * (n[a] + n[b] - len(both)) and both[0] == own
        return i[keep], j[keep]
    shared, before = _overlaps(sets, rank, own)
    both = shared[i, j]
    keep = (100 * both >= percent * (n[i] + n[j] - both)) & ~before[i, j]
    return i[keep], j[keep]


def _overlaps(sets: Sets, rank: np.ndarray, own: int, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """How many words each two sets share, and whether one of them stands before ``own``; by matrix products
    over ``columns`` words at a time, without the words of one set alone."""
    m = len(sets.n)
    names, at, times = np.unique(rank, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sets.n)
    number = np.cumsum(times > 1) - 1
    kept = times[at] > 1
    row, col = row[kept], number[at[kept]]
    early = int((names[times > 1] < own).sum())
    shared, before, width = np.zeros((m, m), np.float32), np.zeros((m, m), bool), int(number[-1]) + 1
    edges = sorted({0, early, width, *range(0, width, columns)})
    for lo, hi in zip(edges, edges[1:]):
        part = (col >= lo) & (col < hi)
        held = np.zeros((m, hi - lo), np.float32)
        held[row[part], col[part] - lo] = 1
        product = held @ held.T
        shared += product
        if hi <= early:
            before |= product > 0
    return shared, before
