r"""Personal data: base patterns, and bootstrapped contextual extraction.

Base spans are found by patterns of form (e-mail, IP address, payment card, phone number).  They are the
seeds.  A lexical pattern is what stands beside a place on its line: the word before it, the two words
before it, or the word after it; words are cut at white space and at ``:=,;"'()<>[]{}|`` too, lower-cased,
digits as 0, and the line's start or end is a word of its own.  The part of a word that a value is glued to
counts as the word before it.  Other places that look like identifiers (masked, spaced, badly formed, also
over several words) are candidates.  In rounds, Spark scores the graph of patterns and instances (values):

* a seed has score 1;
* a pattern is what enough distinct accepted values of a kind, in enough documents, stand beside; its strength
  is the sum of its instances' scores over all its occurrences in the corpus, whatever stands there, so
  "of the" never becomes a pattern of phone numbers, however often one follows it;
* another instance has score 1 - product(1 - strength) over the patterns beside it that reach ``accept``.

Instances that reach ``accept`` become further spans, and in the next round they induce patterns like the
seeds do, whose occurrences are then counted.  Rounds end when nothing is accepted anew.  Base spans always
stay.  Patterns and instances live in DataFrames; only hashes of new patterns are collected, in blocks of
about ``block``, with one pass over the texts for each block.

Edge cases: a null or empty text has no spans.  Spans are in code points, end exclusive.  Rows that agree
in id and text get the same spans.  Extra columns are ignored.  Empty tables give empty results.  All
patterns take time in proportion to the text's length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from .hashing import Alphabet, bytes_hashed, hashed_words, mix, signed

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: What an unseen instance looks like, by kind, and how many digits or masks it has at least.
_CANDIDATES = [
    (0, re.compile(r"(?<![^\s:=,;\"'()<>\[\]{}|])[^\s@:=,;\"'()<>\[\]{}|]{2,64}(?:@|\(at\)|\[at\])[^\s@:=,;\"'()<>\[\]{}|]{3,64}"), 0),
    (1, re.compile(r"(?<![0-9A-Za-z.:*])(?=[0-9a-fA-F*x]{0,4}[.:])[0-9a-fA-F*x]{0,4}(?:[:.][0-9a-fA-F*x]{0,4}){3,7}(?![0-9A-Za-z*])"), 2),
    (3, re.compile(r"(?<![0-9A-Za-z*+(])[+(]{0,2}[0-9*xX]{1,5}(?:[ ()./-]{1,2}[0-9*xX]{1,5}){1,5}(?![0-9A-Za-z*])"), 7),
]
#: Runs of digits and masks with one space or hyphen between, and what cards are made of: three to seven pieces of two to
#: six, a run being one or more of them.
_RUNS = re.compile(r"(?<![0-9*xX])[0-9*xX]++(?:[ -][0-9*xX]++)*+")
_RUN = re.compile(r"[0-9*xX]++")
_PIECES, _PIECE, _LEAST_CARD = (3, 7), (2, 6), 12
_COUNTED = frozenset("0123456789*xX")
_PUNCTUATION = ":=,;\"'()<>[]{}|"
_CONTEXT_WORD = re.compile(r"[^\x20\x09-\x0d" + re.escape(_PUNCTUATION) + "]+")
_BYTES = np.arange(256)
#: Words of contexts: more gaps than white space; A-Z lower-cased and digits alike.
CONTEXT = Alphabet(np.isin(_BYTES, [9, 10, 11, 12, 13, 32, *map(ord, _PUNCTUATION)]), np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, np.where((_BYTES >= 48) & (_BYTES <= 57), 48, _BYTES)))
_EDGE = np.uint64(0x243F6A8885A308D3)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of all base spans, in order."""
    found = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                free = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _keys(one: np.ndarray, two: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the patterns of places: of the word before, of the two before (``two`` is the first of
    them) and of the word after."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix(one * step + np.uint64(1)), mix(mix(two * step + np.uint64(2)) + one), mix(after * step + np.uint64(3))


_WORD_HASHES: dict[str, np.uint64] = {}


def _hash(word: str) -> np.uint64:
    if len(_WORD_HASHES) > 200_000:
        _WORD_HASHES.clear()
    if word not in _WORD_HASHES:
        _WORD_HASHES[word] = bytes_hashed(np.frombuffer(word.encode(), np.uint8), CONTEXT)[1][0]
    return _WORD_HASHES[word]


class _Words:
    """The context words of one text, and the patterns beside a place in it."""

    def __init__(self, text: str):
        self.text, self.spans = text, [m.span() for m in _CONTEXT_WORD.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def beside(self, start: int, end: int) -> list[int]:
        at = bisect_left(self.starts, start)
        line = self.text.rfind("\n", 0, start)
        before: list[np.uint64] = []
        for a, b in reversed(self.spans[max(0, at - 2) : at]):
            if a > line:
                before.append(_hash(self.text[a : min(b, start)]))  # of a word that runs into the place, what comes first
        before += [_EDGE] * (2 - len(before))
        after, k = _EDGE, bisect_left(self.starts, end)
        if k < len(self.spans) and "\n" not in self.text[end : self.starts[k]]:
            after = _hash(self.text[slice(*self.spans[k])])
        return [int(x[0]) for x in map(signed, _keys(*(np.array([x], np.uint64) for x in (before[0], before[1], after))))]


def _card_like(text: str) -> Iterator[tuple[int, int]]:
    """Places that look like cards: from each run of digits and masks, as many runs as make up a card; each run is read once
    or twice."""
    for m in _RUNS.finditer(text):
        runs = [r.span() for r in _RUN.finditer(text, m.start(), m.end())]
        if text[m.end() : m.end() + 1].isalpha() and text[m.end()].isascii():  # what a letter follows ends no card
            runs.pop()
        i = 0
        while i < len(runs):
            j, least, most = i, 0, 0
            while j < len(runs) and (size := runs[j][1] - runs[j][0]) >= _PIECE[0] and least - (-size // _PIECE[1]) <= _PIECES[1]:
                least, most, j = least - (-size // _PIECE[1]), most + size // _PIECE[0], j + 1
            if most >= _PIECES[0]:
                yield runs[i][0], runs[j - 1][1]
            i = max(j, i + 1)


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of places that look like identifiers and overlap none of ``taken``, which ascend."""
    found, starts = [], [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # how far the first places go
    places = [(kind, least, m.start(), m.end() - (len(m[0]) - len(m[0].rstrip(".,;:!?")))) for kind, pattern, least in _CANDIDATES for m in pattern.finditer(text)]
    for kind, least, start, end in chain(places, ((2, _LEAST_CARD, a, b) for a, b in _card_like(text))):
        if sum(c in _COUNTED for c in text[start:end]) < least:
            continue
        at = bisect_left(starts, end)
        if not at or reach[at - 1] <= start:
            found.append((start, kind, end))
    return sorted(found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, print, counts, base spans and other identifier-shaped words with their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, places = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append(spans)
                likely = "@" in text or "[at]" in text or "(at)" in text or _DIGIT.search(text)
                others = candidates(text, [(a, b) for a, _, b in spans]) if likely else []
                words = _Words(text) if spans or others else None
                places.append([{"kind": k, "start": a, "end": b, "seed": seed, "value": text[a:b], "contexts": words.beside(a, b)} for seed, some in ((True, spans), (False, others)) for a, k, b in some])
            counts = [pa.array([sum(k == i for _, k, _ in s) for s in base], pa.int64()) for i in range(4)]
            text_of = [joined(s) for s in base]
            sha = pa.array([hashlib.sha256(s.encode()).hexdigest() for s in text_of], pa.string())
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.string()), ("contexts", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), *counts, sha, pa.array(text_of, pa.string()), pa.array(places, kind)], names=["doc_id", "print", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "places"])

    schema = "doc_id bigint, print bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, places array<struct<kind:int,start:int,end:int,seed:boolean,value:string,contexts:array<bigint>>>"
    return _printed(docs).mapInArrow(run, schema)


def _printed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("print"), "text")


def occurrences(docs: DataFrame, contexts: np.ndarray) -> DataFrame:
    """(context, total): how many places of the corpus each pattern stands beside: before a word, or after it."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(contexts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, joined, bounds, starts, hashes in hashed_words(batch.column("text"), alphabet=CONTEXT):
                if not len(starts):
                    continue
                cuts = np.sort(np.concatenate([np.flatnonzero(np.frombuffer(joined, np.uint8) == 10), bounds[1:-1] - 1]))
                line = np.searchsorted(cuts, starts)
                one, two, after = (np.full(len(hashes), _EDGE) for _ in range(3))
                one[1:] = np.where(line[1:] == line[:-1], hashes[:-1], _EDGE)
                two[2:] = np.where(line[2:] == line[:-2], hashes[:-2], _EDGE)
                after[:-1] = np.where(line[1:] == line[:-1], hashes[1:], _EDGE)
                for names in map(signed, _keys(one, two, after)):
                    at = np.searchsorted(wanted, names)
                    at[at == len(wanted)] = 0
                    total += np.bincount(at[wanted[at] == names], minlength=len(wanted))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[used]), pa.array(total[used])], names=["context", "total"])

    return docs.select("text").mapInArrow(run, "context bigint, total bigint").groupBy("context").agg(F.sum("total").alias("total"))


def pattern_graph(found: DataFrame) -> DataFrame:
    """(kind, context, value, n, docs, seed): a row for each pattern and value beside it; tasks add up before
    the shuffle, so that a common pattern is a row for each of its values."""
    places = found.select("doc_id", "print", F.explode("places").alias("p")).select("doc_id", "print", "p.kind", "p.value", "p.seed", F.explode(F.array_distinct("p.contexts")).alias("context"))
    return places.groupBy("kind", "context", "value").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "print").alias("docs"), F.max("seed").alias("seed"))


def induced(edges: DataFrame, accepted: DataFrame, min_seeds: int) -> DataFrame:
    """(kind, context) of patterns beside enough distinct accepted values (kind, value) in enough documents."""
    held = edges.join(accepted.select("kind", "value").hint("shuffle_merge"), ["kind", "value"])
    return held.groupBy("kind", "context").agg(F.count("*").alias("values"), F.sum("docs").alias("docs")).filter((F.col("values") >= min_seeds) & (F.col("docs") >= min_seeds)).select("kind", "context")


def strengths(edges: DataFrame, patterns: DataFrame, totals: DataFrame, accepted: DataFrame) -> DataFrame:
    """(kind, context, strength): scores of a pattern's instances (accepted: kind, value, score; 0 if not there)
    over all its occurrences."""
    held = edges.join(patterns.hint("shuffle_merge"), ["kind", "context"]).join(accepted.hint("shuffle_merge"), ["kind", "value"], "left")
    sums = held.groupBy("kind", "context").agg(F.sum(F.col("n") * F.coalesce("score", F.lit(0.0))).alias("sum"), F.sum("n").alias("seen"))
    joined = sums.join(totals.hint("shuffle_merge"), "context", "left")
    return joined.select("kind", "context", F.least(F.col("sum") / F.greatest(F.coalesce("total", F.lit(0)), F.col("seen")), F.lit(0.999)).alias("strength"))


def scored(edges: DataFrame, strong: DataFrame) -> DataFrame:
    """(kind, value, score): 1 for seeds, else what the strong patterns beside a value give it."""
    held = edges.join(strong.hint("shuffle_merge"), ["kind", "context"], "left")
    chance = 1 - F.exp(F.sum(F.coalesce(F.log(1 - F.col("strength")), F.lit(0.0))))
    return held.groupBy("kind", "value").agg(F.when(F.max("seed"), 1.0).otherwise(chance).alias("score"))


def bootstrap(docs: DataFrame, found: DataFrame, min_seeds: int, accept: float, rounds: int, block: int) -> DataFrame | None:
    """(doc_id, print, start, kind, end) of accepted further spans; None if there are none."""
    edges = stored(pattern_graph(found), "pattern-graph")
    accepted = edges.filter("seed").select("kind", "value", F.lit(1.0).alias("score")).distinct()
    totals, number, strong = None, accepted.count(), None
    for _ in range(rounds):
        patterns = stored(induced(edges, accepted, min_seeds), "patterns")
        new = patterns.select("context").distinct()
        if totals is not None:
            new = new.join(totals.select("context").hint("shuffle_merge"), "context", "left_anti")
        blocks = -(-new.count() // block)
        for k in range(blocks):  # of about ``block`` hashes each
            contexts = new.filter(F.pmod(F.xxhash64("context"), F.lit(blocks)) == k).toArrow()["context"].to_numpy()
            counted = stored(occurrences(docs, contexts), "occurrences")
            totals = counted if totals is None else totals.union(counted)
        if totals is None:
            return None
        strong = stored(strengths(edges, patterns, totals, accepted).filter(F.col("strength") >= accept), "strong-patterns")
        accepted = stored(scored(edges, strong).filter(F.col("score") >= accept), "accepted")
        if accepted.count() == number:
            break
        number = accepted.count()
    good = accepted.join(edges.filter("seed").select("kind", "value").distinct().hint("shuffle_merge"), ["kind", "value"], "left_anti").select("kind", "value")
    if good.isEmpty():
        return None
    places = found.select("doc_id", "print", F.explode("places").alias("p")).select("doc_id", "print", "p.kind", "p.value", "p.seed", "p.start", "p.end", F.explode("p.contexts").alias("context")).filter("not seed")
    placed = places.join(good.hint("shuffle_merge"), ["kind", "value"]).join(strong.select("kind", "context").hint("shuffle_merge"), ["kind", "context"], "left_semi")
    return placed.select("doc_id", "print", "start", "kind", "end").distinct()


def personal_data(docs: DataFrame, min_seeds: int = 5, accept: float = 0.6, rounds: int = 3, block: int = 100_000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all of them), n_added."""
    found = stored(find(docs), "pii")
    new = bootstrap(docs, found, min_seeds, accept, rounds, block)
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    if new is None:
        return found.select(*columns, F.col("base").alias("spans"), F.lit(0).cast("bigint").alias("n_added"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = stored(new.groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new")), "new-spans")
    f, n = found.alias("f"), named.alias("n")
    both = f.join(n.hint("shuffle_merge"), F.col("f.doc_id").eqNullSafe(F.col("n.doc_id")) & F.col("f.print").eqNullSafe(F.col("n.print")), "left")
    parsed = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), (F.array_position(kinds, F.split(s, ":")[0]) - 1).cast("int").alias("kind"), F.split(s, ":")[2].cast("int").alias("end")))
    every = F.sort_array(F.concat(parsed, F.col("new")))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return both.select(*[f"f.{c}" for c in columns], F.when(F.col("new").isNull(), F.col("base")).otherwise(text).alias("spans"), F.greatest(F.size(F.coalesce("new", F.expr("array()"))), F.lit(0)).cast("bigint").alias("n_added"))
