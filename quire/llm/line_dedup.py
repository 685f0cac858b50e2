r"""Line deduplication by an exact set-similarity join.

A line's set is its distinct words (A-Z lower-cased).  Lines with equal sets form a class; a line goes
when an earlier line of the corpus, in the order of (doc_id, hash of the text, line number), has a Jaccard
similarity of ``percent`` or more, be it in its own class or in another.  Classes of different sets are
joined exactly by ``setjoin``: rarity order, prefix, length and positional filters, verification.

One pass over the texts names the lines' classes and counts their words, a second emits prefix words of few
lines, a third the sets of candidates and of lines with a prefix word of many.  A filter, sized by the
candidates' number between fixed bounds, names the candidates in the third; one that says yes too often
costs bytes, not results.

Nothing is capped: a prefix word of more than ``common`` lines (by default the root of the number of lines,
between fixed bounds) is dealt in blocks, and there only sums leave a task.

Edge cases: null or empty texts have no lines.  Lines without a word are neither compared nor removed.
Null ids come first in the order.  Rows with the same id and different texts are documents of their own.
Rows that agree in id and text are one place each: they count as the same lines, so copies of a whole row
treat each other as themselves and stay.  Extra columns are carried by ``without_repeated_lines``.  Empty
tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setjoin
from ._shared import stored
from .hashing import hashed_words

#: Bits of the filters that name candidates, at least and at most.
FILTER_BITS = (1 << 16, 1 << 28)
#: Lines with a word, up to which it is a join key.
COMMON = (512, 32768)


class _Lines(NamedTuple):
    row: np.ndarray
    number: np.ndarray
    sets: setjoin.Sets


def _lines(texts: pa.Array) -> Iterator[_Lines]:
    """The lines with a word: their row, their number in it from 0, and their sets."""
    for lo, joined, bounds, starts, hashes in hashed_words(texts):
        if not len(starts):
            continue
        breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        row = np.searchsorted(bounds, starts, "right") - 1
        number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, bounds)[row]
        opens = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(number) != 0)])
        line = np.cumsum(opens) - 1
        row, number = row[opens] + lo, number[opens]
        for a in range(0, len(row), setjoin.MOST_SETS):
            some = slice(*np.searchsorted(line, [a, a + setjoin.MOST_SETS]))
            yield _Lines(row[a : a + setjoin.MOST_SETS], number[a : a + setjoin.MOST_SETS], setjoin.sets_of(line[some] - a, hashes[some]))


def _read(batch: pa.RecordBatch) -> Iterator[setjoin.Sets]:
    return (lines.sets for lines in _lines(batch.column("text")))


def _printed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("print"), "text")


def line_classes(docs: DataFrame, slots: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, print, line_no, v): the class of every line with a word; and how many lines hold a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            for rows, numbers, sets in _lines(batch.column("text")):
                setjoin.count_into(total, sets.words)
                at, none = pa.array(rows), pa.nulls(len(rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("print").take(at), pa.array(numbers.astype(np.int32)), pa.array(sets.v), none.cast(pa.int32()), none.cast(pa.binary())], names=["doc_id", "print", "line_no", "v", "block", "counts"])
        packed = setjoin.packed_counts(total)
        none = pa.nulls(packed.num_rows)
        yield pa.RecordBatch.from_arrays([*(none.cast(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())), *packed.columns], names=["doc_id", "print", "line_no", "v", "block", "counts"])

    found = stored(_printed(docs).mapInArrow(run, "doc_id bigint, print bigint, line_no int, v bigint, block int, counts binary"), "lines")
    counts = setjoin.collected_counts(setjoin.summed_counts(found.filter("block is not null").select("block", "counts"), slots), slots)
    return found.filter("block is null").select("doc_id", "print", "line_no", "v"), counts


def _filter_of(values: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of ``values`` (x) in a table of ``bits``; Spark sets the bits of a word."""
    at = f"pmod(x, {bits}L)"
    words = values.groupBy(F.expr(f"cast(shiftright({at}, 6) as int)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} & 63 as int))")).alias("set")).toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[np.asarray(words["word"])] = np.asarray(words["set"]).view(np.uint64)
    return table


def _filter_bits(number: int) -> int:
    return min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * max(1, number)).bit_length()))


def _passes(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x % (len(table) << 6)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


_PLACE = ["doc_id", "print", "line_no"]


def repeated_lines(docs: DataFrame, percent: int = 80, slots: int = 1 << 22, common: int | None = None, block: int = 1024) -> DataFrame:
    """doc_id, print, line_no, v, removed, degree of every line with a word: its class, and how many classes
    of different sets that is linked with."""
    lines, counts = line_classes(docs, slots)
    if common is None:
        common = min(COMMON[1], max(COMMON[0], math.isqrt(lines.count())))
    join = setjoin.Join(docs.select("text"), _read, counts, percent, common, block)
    pairs = stored(join.candidates(join.prefixes()), "line-pairs")
    ends = stored(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct(), "line-ends")
    wanted = _filter_of(ends.select(F.col("v").alias("x")), _filter_bits(ends.count()))
    held = docs.sparkSession.sparkContext.broadcast(wanted)
    sets = stored(join.sets_and_members(lambda v: _passes(held.value, v)), "line-sets")
    candidates = sets.filter("word is null").groupBy("v").agg(F.first("set").alias("set"))
    links = stored(join.verified(pairs, candidates), "line-links")

    first = stored(lines.groupBy("v").agg(F.min(F.struct(*_PLACE)).alias("first")).select("v", "first.*"), "line-firsts")
    places = first.join(ends.hint("shuffle_merge"), "v")
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a"))
    other = places.select(F.col("v").alias("w"), F.struct(*_PLACE).alias("other"))
    linked = both.join(other.hint("shuffle_merge"), "w").groupBy("v").agg(F.count("*").alias("degree"), F.min("other").alias("other"))

    members = sets.filter("word is not null").dropDuplicates(["word", "v"])
    sums = join.block_links(members.join(first.hint("shuffle_merge"), "v")).select("v", "degree", F.struct(*_PLACE).alias("other"))
    degrees = stored(linked.unionByName(sums).groupBy("v").agg(F.sum("degree").alias("degree"), F.min("other").alias("other")), "line-degrees")
    known = first.join(degrees.hint("shuffle_merge"), "v", "left").select("v", "degree", F.least(F.struct(*_PLACE), "other").alias("first"))
    judged = lines.join(known.hint("shuffle_merge"), "v").select(*_PLACE, "v", (~F.struct(*_PLACE).eqNullSafe(F.col("first"))).alias("removed"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return judged


def worded_of(text: str) -> Column:
    """The number of a text's lines that have a word."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))).cast("bigint")


def without_repeated_lines(docs: DataFrame, percent: int = 80, **settings) -> DataFrame:
    """The columns of ``docs`` with the text's repeated lines taken out, and n_lines, n_removed, n_links:
    lines with a word, those removed, and links of its lines' classes to classes of other sets."""
    lines = repeated_lines(docs, percent, **settings).drop("v").distinct()
    cut = lines.groupBy("doc_id", "print").agg(F.count("*").alias("lines"), F.sum("degree").alias("links"), F.collect_list(F.when(F.col("removed"), F.col("line_no"))).alias("cut"))
    touched = stored(cut.filter("links > 0 or size(cut) > 0"), "line-cuts")
    held = docs.sparkSession.sparkContext.broadcast(_filter_of(touched.select(F.col("print").alias("x")), _filter_bits(touched.count())))

    @F.pandas_udf("boolean")
    def maybe_touched(prints: pd.Series) -> pd.Series:
        return pd.Series(_passes(held.value, prints.to_numpy()))

    # texts that keep all their lines, and have no links, stay where they are; a row travels as one column, so that no name of its own can clash
    marked = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("print")).withColumn("touched", maybe_touched("print"))
    d, c = marked.filter("touched").alias("d"), touched.hint("shuffle_merge").alias("c")
    joined = d.join(c, F.col("d.row.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.print") == F.col("c.print")), "left")
    stay = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("cut", i))
    text = F.when(F.size("cut") > 0, F.array_join(stay, "\n")).otherwise(F.col("row.text"))
    counts = {"n_lines": worded_of("row.text"), "n_removed": F.lit(0).cast("bigint"), "n_links": F.lit(0).cast("bigint")}
    names = [n for n in docs.columns if n not in counts]
    parts = {"n_removed": F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("bigint"), "n_links": F.coalesce("links", F.lit(0)).cast("bigint")}
    moved = joined.select(*[(text if n == "text" else F.col(f"row.`{n}`")).alias(n) for n in names], F.coalesce("lines", worded_of("row.text")).alias("n_lines"), *[x.alias(n) for n, x in parts.items()])
    rest = marked.filter("not touched").select(*[F.col(f"row.`{n}`").alias(n) for n in names], *[x.alias(n) for n, x in counts.items()])
    return moved.unionByName(rest)
