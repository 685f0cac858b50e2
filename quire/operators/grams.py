"""Runs of words in lines, as 64-bit hashes inside the works' rows.

A gram is a run of neighbouring words of one line.  What few grams are wanted is told by a table of bits that every task
gets: a gram that isn't in it is none of them, and of the others about two in 100,000 are not either, so
only these few are ever compared as text.  Strings are made for grams that are in the table alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import APOSTROPHES, text_lines
from ..sources.tables import written

# Bits of a block, bits for each hash, and how many of them it sets.
BLOCK, BITS, PROBES = 1 << 16, 24, 10
#: Works whose words are held as numbers at a time.
WORKS = 1000
#: What stands between words and between lines.
WORD, LINE = "\n", "\x0b"

_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object)) if len(words) else np.zeros(0, np.uint64)


class Bits:
    """Blocks of bits; a hash belongs to one of them and sets PROBES bits there."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @staticmethod
    def _start(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = _mixed(h * _FACTOR)
        return (m & np.uint64(BLOCK - 1)).astype(np.int64), ((m >> np.uint64(16)) & np.uint64(BLOCK - 1)).astype(np.int64) | 1

    @staticmethod
    def _place(at: np.ndarray, step: np.ndarray, j: int) -> np.ndarray:
        return at + j * step + j * (j - 1) // 2 & BLOCK - 1

    @staticmethod
    def made(h: np.ndarray) -> bytes:
        """A block with the bits of these hashes."""
        bits = np.zeros(BLOCK, np.uint8)
        for j in range(PROBES):
            bits[Bits._place(*Bits._start(h), j)] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        left = np.arange(len(h))
        block = np.mod(h.view(np.int64), len(self.blocks))
        at, step = self._start(h)
        flat, block = self.blocks.ravel(), block * (BLOCK >> 3)
        for j in range(PROBES):
            place = self._place(at, step, j)
            hit = np.take(flat, block + (place >> 3)) >> (place & 7).astype(np.uint8) & 1 == 1
            left, block, at, step = left[hit], block[hit], at[hit], step[hit]
        found[left] = True
        return found


def bits_of(hashes: DataFrame) -> Bits:
    return bits_in(written(hashes.select("h"), "hashes"))


def bits_in(held: DataFrame) -> Bits:
    """The table of bits of ``h`` of a stored table.  Tasks make its blocks; what comes together is BITS bits a hash."""
    many = max(1, -(-held.count() * BITS // BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Bits.made(one.values.to_numpy(zero_copy_only=False).view(np.uint64)) for one in batch.column("hs")]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(rows, pa.binary())], names=["block", "bits"])

    grouped = held.groupBy(F.pmod("h", F.lit(many)).cast("int").alias("block")).agg(F.collect_list("h").alias("hs"))
    blocks = np.zeros((many, BLOCK // 8), np.uint8)
    for row in grouped.mapInArrow(run, "block int, bits binary").toLocalIterator():
        blocks[row.block] = np.frombuffer(row.bits, np.uint8)
    return Bits(blocks)


#: No hash is in it.
NONE = Bits(np.zeros((1, BLOCK // 8), np.uint8))


class Part:
    """Words of some works' lines as numbers, with the hashes of their runs."""

    def __init__(self, works: pa.Array, of_work: np.ndarray, size: np.ndarray, names: pa.Array, code: np.ndarray):
        """``of_work``: lines of each work; ``size``: words of each line; ``code``: each word's place among ``names``."""
        self.works, self.names, self.code, self.of_work, self.size = works, names, code, of_work, size
        self.work_of = np.repeat(np.arange(len(of_work)), of_work)  # of a line
        self.number = np.arange(len(size)) - np.repeat(np.cumsum(of_work) - of_work, of_work)
        self.line = np.repeat(np.arange(len(size)), size)  # of a word
        begins = np.cumsum(size) - size
        self.left = np.repeat(begins + size, size) - np.arange(len(self.code))  # words from here to the line's end
        counts = np.bincount(self.work_of, size, len(of_work)).astype(np.int64)
        self.place = np.arange(len(self.code)) - (np.cumsum(counts) - counts)[self.work_of[self.line]]  # in the work, from 0
        self.own = _word_hashes(self.names)[self.code]

    @staticmethod
    def read(batch: pa.RecordBatch) -> Part:
        """Of rows of ``lines_of_words``."""
        lines = pc.split_pattern(batch.column("words"), LINE)
        of_work = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        each = lines.flatten()
        size = pc.if_else(pc.equal(each, ""), 0, pc.add(pc.count_substring(each, WORD), 1)).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.split_pattern(each.filter(pc.not_equal(each, "")), WORD).flatten().dictionary_encode()
        return Part(batch.column("work_id"), of_work, size, words.dictionary, words.indices.to_numpy(zero_copy_only=False))

    @staticmethod
    def stored(batch: pa.RecordBatch, row: int) -> Part:
        """Of a row of ``coded``."""
        held = {name: batch.column(name)[row].values for name in batch.schema.names}
        number = lambda name: held[name].to_numpy(zero_copy_only=False).astype(np.int64)
        return Part(held["work_id"], number("lines"), number("sizes"), held["names"], held["codes"].to_numpy(zero_copy_only=False))

    def hashes(self, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, where, hash) of the runs of each size."""
        at, h = np.arange(len(self.code)), self.own
        for n in range(1, max(sizes) + 1):
            if n > 1:
                keep = self.left[at] >= n
                at, h = at[keep], _mixed(h[keep] * _FACTOR + self.own[at[keep] + n - 1])
            if n in sizes:
                yield n, at, h

    def held(self, sizes: list[int], among: Bits | None, lead: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Those in the table; with ``lead``, those whose runs of that many words all are."""
        inside = None
        if among is not None and lead:
            _, at, h = next(self.hashes([lead]))
            inside = np.zeros(len(self.code) + 1, np.int64)
            inside[at] = among.holds(h)
            inside = np.concatenate([[0], np.cumsum(inside)])
        for n, at, h in self.hashes(sizes):
            keep = slice(None) if among is None else inside[at + n - lead + 1] - inside[at] == n - lead + 1 if lead else among.holds(h)
            yield n, at[keep], h[keep]

    def nested(self, sizes: list[int], among: Bits) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``held`` of a table that has the parts of all its runs: a run is looked for where the two of a word less are."""
        at, h = np.arange(len(self.code)), self.own
        for n in range(2, max(sizes) + 1):
            keep = self.left[at] >= n
            if n > min(sizes):
                keep[:-1] &= np.diff(at) == 1
                keep[-1:] = False
            at, h = at[keep], _mixed(h[keep] * _FACTOR + self.own[at[keep] + n - 1])
            if n >= min(sizes):
                hit = among.holds(h)
                at, h = at[hit], h[hit]
                yield n, at, h

    def phrases(self, n: int, at: np.ndarray) -> pa.Array:
        parts = [self.names.take(pa.array(self.code[at + k])) for k in range(n)]
        return pc.binary_join_element_wise(*parts, " ")

    def texts(self, n: np.ndarray, at: np.ndarray) -> pa.Array:
        """``phrases`` of runs of any sizes, in their order."""
        parts = [self.phrases(k, at[n == k]).cast(pa.string()) for k in np.unique(n).tolist()]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.argsort(n, kind="stable")))) if parts else pa.array([], pa.string())

    def runs(self, sizes: list[int], among: Bits, others: pa.Array, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(words, where) of the runs in the table but ``others``, from left to right, the shorter first.  ``whole``: the table has the
        parts of its runs, and all sizes from the least on are asked for."""
        found = [(np.full(len(at), n), at, h) for n, at, h in (self.nested if whole else self.held)(sizes, among)]
        n, at, h = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort([n, at])
        n, at, h = n[order], at[order], h[order]
        if len(others):
            maybe = np.flatnonzero(np.isin(h, _whole_hashes(pc.replace_substring(others, " ", WORD))))
            out = pc.is_in(self.texts(n[maybe], at[maybe]), others).to_numpy(zero_copy_only=False)
            keep = np.ones(len(n), bool)
            keep[maybe[out]] = False
            n, at = n[keep], at[keep]
        return n, at


def _whole_hashes(words: pa.Array) -> np.ndarray:
    """The hashes of phrases from end to end (words with WORD between)."""
    part = Part.read(pa.RecordBatch.from_arrays([pa.array(range(len(words))), words], names=["work_id", "words"]))
    whole = part.place == 0  # the runs that are a phrase from end to end
    sizes = [n for n in np.unique(part.left[whole]).tolist() if n > 1]
    found = [h[whole[at] & (part.left[at] == n)] for n, at, h in part.hashes(sizes)] if sizes else []
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _chain(starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Of runs by their start, the first, then the first that begins behind it, and so on."""
    behind = np.searchsorted(starts, starts + size).tolist()
    taken, i = [], 0
    while i < len(behind):
        taken.append(i)
        i = behind[i]
    return np.array(taken, np.int64)


def longest_first(n: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """For each run (``n`` words from ``at``, no two the same) the number of the first chosen one that it overlaps, its own if it is
    chosen: the longest are chosen first, then the earliest.  Lines need no mark, as no run leaves its own."""
    none = len(at)
    owner, by = np.full(words, none), np.full(none, none)
    order, count = [np.zeros(0, np.int64)], 0
    for size in np.unique(n)[::-1].tolist():
        some = np.flatnonzero(n == size)
        some = some[np.argsort(at[some], kind="stable")]
        first = lambda: np.min([owner[at[some] + k] for k in range(size)], axis=0)
        free = some[first() == none]
        mine = free[_chain(at[free], size)]
        for k in range(size):
            owner[at[mine] + k] = count + np.arange(len(mine))
        order.append(mine)
        count += len(mine)
        by[some] = first()
    return np.concatenate(order)[by]


def leftmost_first(n: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """From left to right, the longest run at a word, and the next behind it: their own numbers for the chosen ones, -1 for others."""
    order = np.lexsort([-n, at])
    first = order[np.concatenate([[True], np.diff(at[order]) > 0])] if len(at) else order
    mine = first[_chain(at[first], n[first])]
    by = np.full(len(at), -1)
    by[mine] = mine
    return by


def lines_of_words(works: DataFrame, pattern: str, **more: Column) -> DataFrame:
    """work_id, words: the words of each line, in lower case, as one string; no line holds either separator."""
    return works.select("work_id", *[c.alias(k) for k, c in more.items()], F.lower(F.array_join(F.transform(text_lines(F.col("text")), lambda x: F.array_join(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), WORD)), LINE)).alias("words"))


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Part]]:
    """Rows of ``lines_of_words``, some at a time, and their words."""
    for batch in batches:
        for start in range(0, batch.num_rows, WORKS):
            some = batch.slice(start, WORKS)
            yield some, Part.read(some)


def coded(works: DataFrame, pattern: str) -> DataFrame:
    """The words of works as numbers, a row for up to WORKS of them: what takes works here takes these rows too, and the texts are
    parted into words once."""
    kind = works.schema["work_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a, t))
        for _, part in slices(batches):
            rows = [one(part.works, None), *[one(x.astype(np.int32), pa.int32()) for x in (part.of_work, part.size)], one(part.names.cast(pa.string()), None), one(part.code.astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(rows, names=["work_id", "lines", "sizes", "names", "codes"])

    return lines_of_words(works, pattern).mapInArrow(run, f"work_id array<{kind}>, lines array<int>, sizes array<int>, names array<string>, codes array<int>")


def _source(works: DataFrame, pattern: str) -> DataFrame:
    return works if "codes" in works.columns else lines_of_words(works, pattern)


def _kind(works: DataFrame) -> str:
    kind = works.schema["work_id"].dataType
    return (kind.elementType if "codes" in works.columns else kind).simpleString()


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        if "codes" in batch.schema.names:
            yield from (Part.stored(batch, i) for i in range(batch.num_rows))
        else:
            yield from (part for _, part in slices([batch]))


def _counted(works: DataFrame, sizes: list[int], pattern: str, least: int, among=None, lead: int = 0) -> DataFrame:
    """h of the grams that occur at least so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            for _, _, h in part.held(sizes, among.value if among else None, lead):
                one, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return _source(works, pattern).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h")


def frequent_hashes(works: DataFrame, sizes: list[int], pattern: str, least: int) -> DataFrame:
    """h of the grams of these sizes that occur at least so often by hash.

    Runs of the smallest size are counted first, then longer ones all of whose such runs are frequent."""
    send = works.sparkSession.sparkContext.broadcast
    lead, more = min(sizes), [n for n in sizes if n > min(sizes)]
    found = _counted(works, [lead], pattern, least)
    if more:
        found = written(found, "grams")
        found = found.unionByName(_counted(works, more, pattern, least, send(bits_in(found)), lead))
    return found


def counted_phrases(works: DataFrame, sizes: list[int], pattern: str, bits: Bits) -> DataFrame:
    """phrase, n: how often each gram in the table occurs, counted as text: those that are frequent by hash and the few that are
    in the table by chance."""
    rows = phrase_lines(works, sizes, pattern, bits, whole=True).select(F.explode("s.phrase").alias("phrase"))
    return rows.groupBy("phrase").agg(F.count("*").alias("n"))


def frequent_phrases(works: DataFrame, sizes: list[int], pattern: str, least: int) -> DataFrame:
    """phrase: the grams of these sizes that occur at least so often.  Only what is frequent by hash is counted as text, which decides."""
    bits = bits_of(frequent_hashes(works, sizes, pattern, least))
    return counted_phrases(works, sizes, pattern, bits).filter(F.col("n") >= least).select("phrase")


def phrase_bits(phrases: DataFrame) -> Bits:
    """The table of bits of listed phrases (words with one space between)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_whole_hashes(batch.column("words")).view(np.int64))], names=["h"])

    return bits_of(phrases.select(F.translate("phrase", " ", WORD).alias("words")).mapInArrow(run, "h long"))


def phrase_lines(works: DataFrame, sizes: list[int], pattern: str, bits: Bits, others: list[str] | None = None, whole: bool = False) -> DataFrame:
    """work_id, line_no, s: a row for each line with a gram in the table, and its grams from left to right, the shorter first:
    first, last, phrase.  ``others``: phrases that are in the table by chance."""
    among = works.sparkSession.sparkContext.broadcast(bits)
    out = works.sparkSession.sparkContext.broadcast(others or [])
    kind = _kind(works)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unwanted = pa.array(out.value, pa.string())
        for part in _parts(batches):
            n, at = part.runs(sizes, among.value, unwanted, whole)
            text = part.texts(n, at)
            line, size = np.unique(part.line[at], return_counts=True)
            first = part.place[at] + 1
            structs = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array((first + n - 1).astype(np.int32)), text], names=["first", "last", "phrase"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([part.works.take(pa.array(part.work_of[line])), pa.array((part.number[line] + 1).astype(np.int32)), lists], names=["work_id", "line_no", "s"])

    return _source(works, pattern).mapInArrow(run, f"work_id {kind}, line_no int, s array<struct<first: int, last: int, phrase: string>>")


class Listed:
    """Listed phrases: the numbers of words they have, the table of their bits, and the phrases that are in it by chance."""

    def __init__(self, sizes: list[int], bits: Bits, others: list[str], whole: bool = False):
        self.sizes, self.bits, self.others, self.whole = sizes, bits, others, whole

    def runs(self, part: _Part, choose) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, where, by) of the phrases in these works, and whether each word stands in a chosen one.  ``choose``:
        ``longest_first`` or ``leftmost_first``."""
        n, at = part.runs(self.sizes, self.bits, pa.array(self.others, pa.string()), self.whole)
        by = choose(n, at, len(part.code))
        mine = np.flatnonzero(by == np.arange(len(by)))
        edge = np.bincount(at[mine], minlength=len(part.code) + 1) - np.bincount(at[mine] + n[mine], minlength=len(part.code) + 1)
        return n, at, by, np.cumsum(edge)[:-1] > 0


def normal(names: pa.Array) -> pa.Array:
    """As ``normal_form`` has words that are in lower case."""
    for mark, plain in zip(*APOSTROPHES):
        names = pc.replace_substring(names, mark, plain)
    return names


def judged_phrases(works: DataFrame, pattern: str, listed: Listed, choose=longest_first) -> DataFrame:
    """work_id, line_no, first, last, phrase, selected, suppressed_by of every listed phrase in the works' lines, judged where it is found."""
    held = works.sparkSession.sparkContext.broadcast(listed)
    kind = _kind(works)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            n, at, by, _ = held.value.runs(part, choose)
            text, line, first, own = part.texts(n, at), part.line[at], part.place[at] + 1, by == np.arange(len(by))
            clash = text.take(pa.array(by, mask=own | (by < 0)))
            rows = [part.works.take(pa.array(part.work_of[line])), pa.array((part.number[line] + 1).astype(np.int32)), pa.array(first.astype(np.int32)), pa.array((first + n - 1).astype(np.int32)), text, pa.array(own), clash]
            yield pa.RecordBatch.from_arrays(rows, names=["work_id", "line_no", "first", "last", "phrase", "selected", "suppressed_by"])

    return _source(works, pattern).mapInArrow(run, f"work_id {kind}, line_no int, first int, last int, phrase string, selected boolean, suppressed_by string")


class Scope:
    """Words in scope, by the table of their bits, and those that are in it by chance."""

    def __init__(self, bits: Bits, others: list[str]):
        self.bits, self.others = bits, others

    def holds(self, names: pa.Array) -> np.ndarray:
        found = self.bits.holds(_word_hashes(names))
        return found & ~pc.is_in(names, pa.array(self.others, pa.string())).to_numpy(zero_copy_only=False) if self.others else found


def scope_of(words: DataFrame) -> Scope:
    """``words``: a stored table of word, inside; every word that will be asked for is a row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_word_hashes(batch.column("word")).view(np.int64))], names=["h"])

    bits = bits_of(words.filter("inside").select("word").mapInArrow(hashed, "h long"))
    held = words.sparkSession.sparkContext.broadcast(bits)

    def by_chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.holds(_word_hashes(batch.column("word")))))

    return Scope(bits, [r.word for r in words.filter("not inside").select("word").mapInArrow(by_chance, "word string").toLocalIterator()])


def covered_words(works: DataFrame, pattern: str, listed: Listed, choose=longest_first, scope: Scope | None = None) -> DataFrame:
    """work_id, pos, form, in_scope of each word in a chosen phrase; the last says whether the phrase has a word in ``scope``."""
    held = works.sparkSession.sparkContext.broadcast((listed, scope))
    kind = _kind(works)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, scope = held.value
        for part in _parts(batches):
            n, start, by, inside = listed.runs(part, choose)
            at = np.flatnonzero(inside)
            wanted = pa.nulls(len(at), pa.bool_())
            if scope:
                mine = np.flatnonzero(by == np.arange(len(by)))
                mine = mine[np.argsort(start[mine])]
                sums = np.concatenate([[0], np.cumsum(scope.holds(part.names)[part.code])])
                wanted = pa.array(np.repeat(sums[start[mine] + n[mine]] > sums[start[mine]], n[mine]))
            rows = [part.works.take(pa.array(part.work_of[part.line[at]])), pa.array((part.place[at] + 1).astype(np.int32)), normal(part.names).take(pa.array(part.code[at])).cast(pa.string()), wanted]
            yield pa.RecordBatch.from_arrays(rows, names=["work_id", "pos", "form", "in_scope"])

    return _source(works, pattern).mapInArrow(run, f"work_id {kind}, pos int, form string, in_scope boolean")


def words_apart(works: DataFrame, pattern: str, listed: Listed, choose=longest_first) -> DataFrame:
    """work_id, form, free, covered: a row for each form of a work, the places where it stands outside the chosen phrases, and how
    often it stands in one."""
    held = works.sparkSession.sparkContext.broadcast(listed)
    kind = _kind(works)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            inside = held.value.runs(part, choose)[-1]
            named = normal(part.names).dictionary_encode()
            forms, code = named.dictionary, named.indices.to_numpy(zero_copy_only=False)[part.code]
            key, of = np.unique(part.work_of[part.line] * np.int64(len(forms)) + code, return_inverse=True)
            free = np.flatnonzero(~inside)
            many = np.bincount(of[free], minlength=len(key))
            at = free[np.argsort(of[free], kind="stable")]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array((part.place[at] + 1).astype(np.int32)))
            rows = [part.works.take(pa.array(key // max(1, len(forms)))), forms.take(pa.array(key % max(1, len(forms)))).cast(pa.string()), lists, pa.array(np.bincount(of, inside, len(key)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(rows, names=["work_id", "form", "free", "covered"])

    return _source(works, pattern).mapInArrow(run, f"work_id {kind}, form string, free array<int>, covered int")


def chosen_longest(per_line: DataFrame) -> DataFrame:
    """work_id, line_no, first, last, phrase, selected, suppressed_by of the spans ``s`` of each line: the longest first, then the
    earliest, then by phrase; a span is suppressed by the first chosen one that it overlaps."""
    kind = per_line.schema["work_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("s")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            spans = lists.flatten()
            first, last, phrase = spans.flatten()
            line = np.repeat(np.arange(len(size)), size)
            a, b = first.to_numpy(zero_copy_only=False).astype(np.int64), last.to_numpy(zero_copy_only=False).astype(np.int64)
            by_text = np.asarray(pc.rank(phrase, "ascending", tiebreaker="dense")).astype(np.int64)
            order = np.lexsort([by_text, a, a - b, line])
            by = np.full(len(a), -1)
            taken, now = {}, -1
            for place, (i, k, x, y) in enumerate(zip(order.tolist(), line[order].tolist(), a[order].tolist(), b[order].tolist())):
                if k != now:
                    taken, now = {}, k
                clash = min((taken[t] for t in range(x, y + 1) if t in taken), default=-1)
                if clash < 0:
                    taken.update(dict.fromkeys(range(x, y + 1), place))
                else:
                    by[i] = order[clash]
            rows = [batch.column("work_id").take(pa.array(line)), batch.column("line_no").take(pa.array(line)), first, last, phrase, pa.array(by < 0), phrase.take(pa.array(by, mask=by < 0))]
            yield pa.RecordBatch.from_arrays(rows, names=["work_id", "line_no", "first", "last", "phrase", "selected", "suppressed_by"])

    number = per_line.schema["line_no"].dataType.simpleString()
    whole = per_line.select("work_id", "line_no", F.transform("s", lambda x: F.struct(x["first"].cast("int").alias("first"), x["last"].cast("int").alias("last"), x["phrase"].alias("phrase"))).alias("s"))
    return whole.mapInArrow(run, f"work_id {kind}, line_no {number}, first int, last int, phrase string, selected boolean, suppressed_by string")
