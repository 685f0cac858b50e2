r"""Language identification with language-bitmask n-gram filters.

Training counts hashed 4-grams of characters (letters lower-cased, anything else a space, no space
inside) per language over all training rows.  A language contains an n-gram if it makes up at least
``min_share`` of the language's n-grams, at least ``min_count`` times, and isn't ``contrast`` times
rarer there than in the language that uses it most.  The filters are bit-sliced Bloom filters: one slot
for each hash position holds a mask with a bit for each language, so ANDing an n-gram's slots returns
all languages that contain it at once.  Masks take one 64-bit word for each 64 languages.

A text is judged by the popcount of each language's bit over its n-grams, corrected for the false
positives that the filter's fill predicts; the largest corrected share wins and is the score.

Bounds: a language has at most 1 / ``min_share`` n-grams, and the table ``slots`` words for each 64
languages, whatever the corpus; only the table is broadcast.  Counts cover all training rows.

Edge cases: a text without letters, or null, is ``und`` with score 0.  A text with letters but without
a known n-gram gets the language with most training n-grams and score 0; without any training rows every
text is ``und``.  Ties go to the language first in order.  Rows with a null language train nothing.
Repeated rows count each time.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from .hashing import mix, signed

GRAM = 4
_LETTERS: list[np.ndarray] = []
_K = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(1, GRAM + 1)]


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str) -> tuple[np.ndarray, bool]:
    """Hashes of the text's n-grams in order, and whether it has a letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64), False
    codes = np.where(letter, codes, 32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), True
    inside = np.ones(n, bool)
    for k in range(1, GRAM - 1):
        inside &= letter[k : n + k]
    total = np.zeros(n, np.uint64)
    for k in range(GRAM):
        total += codes[k : n + k] * _K[k]
    return mix(total[inside]), True


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of each task, summed up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def add(lang: str, gram: np.ndarray, n: np.ndarray) -> None:
            values, back = np.unique(gram, return_inverse=True)
            held[lang] = [values, np.bincount(back, n, len(values)).astype(np.int64)]

        for batch in batches:
            new: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                new.setdefault(lang, []).append(grams(text)[0])
            for lang, parts in new.items():
                old = held.get(lang, [np.zeros(0, np.uint64), np.zeros(0, np.int64)])
                fresh = np.concatenate(parts)
                add(lang, np.concatenate([old[0], fresh]), np.concatenate([old[1], np.ones(len(fresh), np.int64)]))
            if sum(len(x[0]) for x in held.values()) > 4_000_000:
                yield from out(held)
                held.clear()
        yield from out(held)

    def out(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, (gram, n) in held.items():
            for lo in range(0, len(gram), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram[part]), pa.string()), pa.array(signed(gram[part])), pa.array(n[part])], names=["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return counted.groupBy("gram", "lang").agg(F.sum("n").alias("n"))


class Filters:
    """The table of masks and what is needed to read it."""

    def __init__(self, langs: list[str], default: str, table: np.ndarray, hashes: int):
        self.langs, self.default, self.table, self.hashes = langs, default, table, hashes
        slots, bits = table.shape[1], np.uint64(1) << np.arange(64, dtype=np.uint64)
        fill = [np.count_nonzero(table[i // 64] & bits[i % 64]) / slots for i in range(len(langs))]
        self.false_rate, self.bits = np.array(fill) ** hashes, bits

    def containing(self, gram: np.ndarray) -> np.ndarray:
        """Masks [words, grams] of the languages that contain each n-gram."""
        slots, found = np.uint64(self.table.shape[1]), None
        for at in positions(gram, self.hashes, slots):
            mask = self.table[:, at]
            found = mask if found is None else found & mask
        return found

    def judge(self, text: str | None) -> tuple[str, float]:
        gram, has_letter = grams(text) if text else (None, False)
        if not has_letter or not self.langs:
            return "und", 0.0
        if not len(gram):
            return self.default, 0.0
        masks = self.containing(gram)
        hits = np.array([np.count_nonzero(masks[i // 64] & self.bits[i % 64]) for i in range(len(self.langs))])
        share = np.clip((hits / len(gram) - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(share.argmax())
        return (self.langs[best], float(share[best])) if share[best] > 0 else (self.default, 0.0)


def positions(gram: np.ndarray, hashes: int, slots) -> list[np.ndarray]:
    second = mix(gram) | np.uint64(1)
    return [((gram + second * np.uint64(k)) >> np.uint64(11)) % np.uint64(slots) for k in range(hashes)]


def train_filters(rows: DataFrame, min_share: float = 2e-6, min_count: int = 3, contrast: float = 20.0, slots: int = 1 << 21, hashes: int = 3) -> Filters:
    """Learn from ``text`` and ``lang`` of all rows."""
    counts = stored(count_grams(rows.filter("text is not null and lang is not null")), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()  # one row a language
    langs = [r.lang for r in totals]
    if not langs:
        return Filters([], "und", np.zeros((1, slots), np.uint64), hashes)
    numbers = rows.sparkSession.createDataFrame([(r.lang, i, float(r.total)) for i, r in enumerate(totals)], "lang string, i int, total double")
    shares = counts.join(F.broadcast(numbers), "lang").withColumn("share", F.col("n") / F.col("total"))
    kept = shares.filter((F.col("share") >= min_share) & (F.col("n") >= min_count))
    most = kept.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("i", "share")).alias("each"))
    # a row for each n-gram and 64 languages, its mask the bits of the languages that hold it
    held = most.select("gram", F.explode(F.expr(f"filter(each, e -> e.share * {contrast} >= top)")).alias("e"))
    masks = held.groupBy("gram", F.floor(F.col("e.i") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, e.i % 64))").alias("mask"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = np.asarray(batch.column("gram")).view(np.uint64)
            for at in positions(gram, hashes, slots):
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(at.astype(np.int32)), batch.column("mask")], names=["word", "slot", "mask"])

    filled = masks.mapInArrow(spread, "word int, slot int, mask bigint").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    table = np.zeros(((len(langs) + 63) // 64, slots), np.uint64)
    got = filled.toArrow()  # at most ``slots`` rows for each 64 languages
    table[np.asarray(got["word"]), np.asarray(got["slot"])] = np.asarray(got["mask"]).view(np.uint64)
    return Filters(langs, max(totals, key=lambda r: (r.total, r.lang)).lang, table, hashes)


def identify(docs: DataFrame, filters: Filters, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [shared.value.judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
