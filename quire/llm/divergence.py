r"""How far the sources of a language are from each other and from their language, by chunk factorization.

A term is a run of letters and of characters outside ASCII, ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``, A-Z
lower-cased.  White space ends a term, so a text's terms are those of its white-space chunks:

1. ``chunk_counts``: each document's chunks are counted, and a batch's counts added up by group (language and
   source) before they travel, a row a chunk.
2. ``chunk_table``: the task that owns a chunk adds up its rows and cuts it into terms once, whatever its number of
   uses: a row for each globally distinct chunk, its terms and its counts by group.
3. Its terms join its counts.  Occurrences of a term are a sum.  A document that holds a term in two chunks
   would count twice, so documents are bounded from both sides: at least those of the term's commonest chunk in
   each group, at most the sum of all its chunks.
4. Where ``min_docs`` lies between the bounds, and only there, documents are read again: those chunks meet
   their terms, and distinct documents are counted.  A Bloom filter of ``bits`` bits keeps most other chunks
   out of that join; the join decides.

Each language keeps the terms of at least ``min_docs`` of its documents.  A group, a language and source, or a
language gives a kept term p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N the group's occurrences of kept terms
and V their number, in integers, by long division in steps of 1000, right for counts below 9 * 10**15.

``divergence_audit`` returns for each group its distance from each other source of the language (part
``pair``: the sum of abs(p - q) over the kept terms, 0 without any) and the ``top`` terms that it has more of
than its language (part ``term``).  Distances are sums of blocks of terms by sources in the tasks that hold
the terms; work and result grow with the square of the number of sources of a language.

Edge cases: a null text, lang or source is ''.  A group without terms has pairs and no terms.  Ties rank by
the item's UTF-8.  Rows that repeat are documents of their own.  A long text is cut in slices of texts
only, a chunk of any length is one key, sent once a batch.  An empty table gives an empty result.  Columns
other than text, lang and source are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import lower_ascii, shuffle_width, stored
from .chunks import _sliced

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def numbered_groups(filled: DataFrame) -> DataFrame:
    """(lang, source, g): a number for each group that occurs, stored, so that joins with it go by its true size."""
    return stored(filled.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()), "group-numbers")


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each chunk its text's number and its place among the distinct chunks, which come last."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), coded.indices.to_numpy(), coded.dictionary


_COUNTS = "chunk string, gs array<bigint>, docs array<bigint>, ns array<bigint>"


def _lists(starts: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.append(starts, len(values[0])).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64))) for v in values]


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(chunk, gs, docs, ns): a row for each chunk of a batch, with the groups that have it there, their documents and
    its occurrences.  ``docs``: g and text without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, group_of, first = *np.unique(batch.column("g").to_numpy(), return_inverse=True), 0
            for texts in _sliced(batch.column("text"), 16 << 20):
                at, chunk, distinct = _cut(texts)
                size = max(1, len(distinct))
                keys, times = np.unique(at * size + chunk, return_counts=True)  # a document's chunk once
                own, where = np.unique(keys % size * len(names) + group_of[first + keys // size], return_inverse=True)
                first += len(texts)
                if not len(own):
                    continue
                chunks, starts = np.unique(own // len(names), return_index=True)
                n = np.bincount(where, times, len(own))  # whole numbers far below 2**53
                yield pa.RecordBatch.from_arrays([distinct.take(pa.array(chunks)), *_lists(starts, names[own % len(names)], np.bincount(where, minlength=len(own)), n)], names=["chunk", "gs", "docs", "ns"])

    return docs.select("g", "text").mapInArrow(run, _COUNTS).filter("chunk <> ''")


_WORD = re.compile(TERM)


def chunk_table(counts: DataFrame) -> DataFrame:
    """(chunk, terms, ks, gs, docs, ns): a row for each globally distinct chunk that holds a term, its counts by group
    added up, and its terms, cut once, with how often it holds them.  The task that owns a range of chunks streams them
    in order and holds the rows of a batch and of one more chunk."""

    def added(rows: pa.Table) -> pa.RecordBatch:
        coded = rows.column("chunk").combine_chunks().dictionary_encode()
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
        of = np.repeat(coded.indices.to_numpy(), pc.list_value_length(rows.column("gs")).to_numpy())
        g = flat("gs")
        order = np.lexsort((g, of))
        of, g = of[order], g[order]
        begin = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (g[1:] != g[:-1])]))
        sums = [np.add.reduceat(flat(c)[order], begin) for c in ("docs", "ns")]
        _, starts = np.unique(of[begin], return_index=True)
        terms = [Counter(_WORD.findall(lower_ascii(c))) for c in coded.dictionary.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
        listed = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(list(chain.from_iterable(values)), kind)) for values, kind in ((terms, pa.string()), ((t.values() for t in terms), pa.int64()))]
        whole = pa.RecordBatch.from_arrays([coded.dictionary, *listed, *_lists(starts, g[begin], *sums)], names=["chunk", "terms", "ks", "gs", "docs", "ns"])
        return whole.filter(pa.array(ends[1:] > ends[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            chunk = rows.column("chunk")
            last = rows.num_rows - pc.sum(pc.equal(chunk, chunk[-1])).as_py()
            if last:
                yield added(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield added(held)

    dealt = counts.repartition(shuffle_width(counts.sparkSession), "chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(run, "chunk string, terms array<string>, ks array<bigint>, gs array<bigint>, docs array<bigint>, ns array<bigint>")


def _slots(chunks: pa.Array, bits: int) -> np.ndarray:
    h = np.fromiter((xxhash.xxh3_64_intdigest(c.as_buffer()) for c in chunks.cast(pa.binary())), np.uint64, len(chunks))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def _filter_of(chunks: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter, ``bits`` a power of 2: at most that many bits come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(_slots(batch.column("chunk"), bits))
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 5), pa.array(np.int64(1) << (slots & 31))], names=["word", "bit"])

    words = chunks.select("chunk").mapInArrow(run, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("held")).toArrow()
    filled = np.zeros(bits // 32, np.int64)
    filled[np.asarray(words["word"])] = np.asarray(words["held"])
    return filled


def _exact_docs(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(lang, term, docs) of the terms of ``wanted`` (lang, chunk, term), counted by document."""
    held = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, bits))  # bits / 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in _sliced(batch.column("text"), 16 << 20):
                at, chunk, distinct = _cut(texts)
                slots = _slots(distinct, bits)
                maybe = (held.value[slots >> 5] >> (slots & 31) & 1).all(axis=0)
                pick = maybe[chunk]
                keys = np.unique(at[pick] * max(1, len(distinct)) + chunk[pick])
                rows = pa.array(first + keys // max(1, len(distinct)))
                first += len(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(rows), batch.column("lang").take(rows), distinct.take(pa.array(keys % max(1, len(distinct))))], names=["doc", "lang", "chunk"])

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), "lang", "text").mapInArrow(run, "doc bigint, lang string, chunk string")
    met = rows.join(wanted.hint("shuffle_merge"), ["lang", "chunk"]).select("lang", "term", "doc").distinct()
    return met.groupBy("lang", "term").agg(F.count("*").alias("docs"))


def kept_counts(docs: DataFrame, groups: DataFrame, min_docs: int = 30, bits: int = 1 << 23) -> DataFrame:
    """(lang, source, term, n > 0) of the terms that each language keeps, stored.  ``docs``: from ``_filled``;
    ``groups``: from ``numbered_groups``."""
    chunks = stored(chunk_table(chunk_counts(docs.join(groups, ["lang", "source"]))), "chunks")
    each = chunks.select(F.explode(F.arrays_zip("terms", "ks")).alias("t"), "gs", "docs", "ns").select("t.terms", "t.ks", F.explode(F.arrays_zip("gs", "docs", "ns")).alias("u"))
    each = each.select(F.col("u.gs").alias("g"), F.col("terms").alias("term"), (F.col("u.ns") * F.col("ks")).alias("n"), F.col("u.docs").alias("docs"))
    counted = each.groupBy("g", "term").agg(F.sum("n").alias("n"), F.max("docs").alias("least"), F.sum("docs").alias("most"))
    found = stored(counted.join(groups, "g").drop("g"), "term-counts")

    bounds = stored(found.groupBy("lang", "term").agg(F.sum("least").alias("least"), F.sum("most").alias("most")).filter(F.col("most") >= min_docs), "term-bounds")
    kept, open_ = bounds.filter(F.col("least") >= min_docs).select("lang", "term"), stored(bounds.filter(F.col("least") < min_docs).select("lang", "term"), "open-terms")
    if not open_.isEmpty():
        wanted = stored(chunks.select("chunk", F.explode("terms").alias("term")).join(open_, "term").select("lang", "chunk", "term"), "open-chunks")
        kept = kept.union(_exact_docs(docs, wanted, bits).filter(F.col("docs") >= min_docs).select("lang", "term"))
    return stored(found.join(stored(kept, "kept-terms"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept-counts")


def _p_sql(count: str, total: str) -> str:
    """p of a count as SQL, by long division."""
    below, rest, digits = f"({total} + 5 * v)", f"({count} + 5)", "0"
    for _ in range(3):
        digits, rest = f"({digits} * 1000 + ({rest} * 1000) div {below})", f"(({rest} * 1000) % {below})"
    return f"(1 + {digits})"


def _p(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """p of an array of counts, ``below`` being N + 5 * V of each column."""
    rest, digits = counts + 5, np.zeros_like(counts)
    for _ in range(3):
        digits, rest = digits * 1000 + rest * 1000 // below, rest * 1000 % below
    return 1 + digits


def _pair_sums(rows: DataFrame) -> DataFrame:
    """(lang, i, j, value), i < j: summed distances of two sources, by their places.  ``rows`` has one of (lang,
    totals, v, at, n) for each kept term: N of all sources, and the places and counts of those that have the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            for code, name in enumerate(lang.dictionary.to_pylist()):
                mine = batch.filter(pa.array(lang.indices.to_numpy() == code))
                below = np.array(mine.column("totals")[0].as_py(), np.int64) + 5 * mine.column("v")[0].as_py()
                total = sums.setdefault(name, np.zeros((len(below), len(below)), np.int64))
                step = max(1, (1 << 20) // len(below))
                for lo in range(0, mine.num_rows, step):
                    part = mine.slice(lo, step)
                    counts = np.zeros((part.num_rows, len(below)), np.int64)
                    lengths = pc.list_value_length(part.column("at")).to_numpy(zero_copy_only=False)
                    counts[np.repeat(np.arange(part.num_rows), lengths), part.column("at").flatten().to_numpy()] = part.column("n").flatten().to_numpy()
                    p = _p(counts, below)
                    for i in range(len(below) - 1):
                        total[i, i + 1 :] += np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(axis=0)
        for name, total in sums.items():
            i, j = np.triu_indices(len(total), 1)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["lang", "i", "j", "value"])

    return rows.mapInArrow(run, "lang string, i int, j int, value bigint").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def divergence_audit(docs: DataFrame, min_docs: int = 30, top: int = 50, bits: int = 1 << 23) -> DataFrame:
    """lang, source, part, item, value, rank."""
    filled = _filled(docs)
    numbers = numbered_groups(filled)
    kept = kept_counts(filled, numbers, min_docs, bits)
    whole = stored(kept.groupBy("lang", "term").agg(F.sum("n").alias("whole")), "term-totals")
    langs = whole.groupBy("lang").agg(F.sum("whole").alias("lang_total"), F.count("*").alias("v"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = numbers.drop("g").join(own.hint("shuffle_merge"), ["lang", "source"], "left").join(langs.hint("shuffle_merge"), "lang", "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "v")], place.alias("at")), "groups")

    # the tables of groups are files, so joins with them go by their true size
    each = kept.join(groups, ["lang", "source"])
    terms = each.join(whole.hint("shuffle_merge"), ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), F.expr(f"{_p_sql('n', 'total')} - {_p_sql('whole', 'lang_total')}").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.filter("value > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    totals = stored(groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda x: x["total"]).alias("totals")), "group-totals")
    rows = each.groupBy("lang", "term", "v").agg(F.collect_list(F.struct("at", "n")).alias("held"))  # at most a place a source
    sums = stored(_pair_sums(rows.join(totals, "lang").select("lang", "totals", "v", F.col("held.at").alias("at"), F.col("held.n").alias("n"))), "pair-sums")
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("to"))
    pairs = groups.select("lang", "source", "at").join(other.hint("shuffle_merge"), "lang").filter(F.col("at") != F.col("to"))
    pairs = pairs.select("lang", "source", "item", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j")).join(sums.hint("shuffle_merge"), ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value")).withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").union(columns(terms, "term"))


#: The same rows in DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
sn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
ln AS (SELECT lang, term, sum(n)::BIGINT AS n, (sum(sum(n)) OVER (PARTITION BY lang))::BIGINT AS total FROM c GROUP BY lang, term),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (sn.total + 5 * v.v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN sn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT ln.lang, ln.term, 1 + (1000000000::HUGEINT * (ln.n + 5)) // (ln.total + 5 * v.v) AS q FROM ln JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50
"""
