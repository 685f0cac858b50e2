r"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Every token is predicted from its neighbours on both sides.  A word's probability has two factors: that
of its class given the classes of the neighbours, from the network, and the word's share of its class.

* Words are counted over all documents, without a limit; the counts stay a table of Spark's.
* The ``vocabulary`` most frequent words travel with the tasks.  The ``alone`` first are classes of their own; the
  others are put in classes by what stands beside them (k-means on their neighbour counts), so that a
  class holds words that are used alike.  All other words are rare; their class follows from their
  first character, and their own count comes from the table of counts by a join.
* The network has a table of hidden contributions for the left and one for the right neighbour's class; their
  sum passes a tanh and a softmax layer.  It sees its data as counts of (left, class, right) over the
  whole corpus, whose number is fixed by that of the classes: every token takes part in every step.

All that is gathered are sums of integers, so neither the model nor a score depends on how documents are
dealt to tasks.  What grows with the corpus stays in Spark: word counts, the encoded texts, and the
counts of each document's rare words.

Edge cases: a null or empty text has no tokens, sum 0 and a null mean.  A document's edges count as a
class of their own.  Words that the counts don't know get the probability of a word seen once.  Empty
tables train nothing and give no rows.  Repeated rows count and are scored each time; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from .hashing import hashed_words, signed
from .setjoin import BLOCK_SLOTS, collected_counts, count_into, packed_counts, summed_counts

#: Classes of rare words, by their first character.
SHAPES = 16
#: Frequent words that serve as features of the words beside them, on each side.
FEATURES = 32


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, words as 64-bit hashes; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            words, back = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in held]), len(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for *_, hashes in hashed_words(batch.column("text")):
                held.append(np.unique(hashes, return_counts=True))
            if sum(len(w) for w, _ in held) > 4_000_000:
                yield merged()
                held.clear()
        if held:
            yield merged()

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``size`` words and their counts: all that occur as often as some limit.  The limit comes from
    the number of words of each count, of which there are few; then only those words are fetched."""
    kinds = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toArrow()
    n, upto = np.asarray(kinds["n"]), np.cumsum(np.asarray(kinds["words"]))
    fits = int(np.searchsorted(upto, size, "right"))
    if not fits:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.filter(F.col("n") >= int(n[fits - 1])).toArrow()
    words, n = np.asarray(got["word"]).view(np.uint64), np.asarray(got["n"])
    order = np.argsort(words)
    return words[order], n[order]


def numbered(hashes: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Ids of tokens: their place among ``words`` (ascending), or beyond those the class of a rare word."""
    letter = (first | 32) - 97
    shape = np.select([(first >= 48) & (first < 58), letter < 26, first >= 128], [0, 1 + letter % 12, 13 + first % 2], 15)
    ids = len(words) + shape.astype(np.int64)
    if len(words):
        at = np.searchsorted(words, hashes)
        at[at == len(words)] = 0
        ids = np.where(words[at] == hashes, at, ids)
    return ids.astype(np.uint16)


def encode(docs: DataFrame, words: np.ndarray, n: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(row, doc_id, ids, rare) of every document: ids as two bytes a token, and the hashes of rare words;
    and for each of ``words`` how often each of the FEATURES most frequent ones stands left and right of it."""
    if len(words) + SHAPES > 1 << 16:
        raise ValueError(f"a vocabulary of at most {(1 << 16) - SHAPES} words has ids of two bytes")
    shared = docs.sparkSession.sparkContext.broadcast(words)
    feature = np.full(len(words) + SHAPES, -1, np.int64)
    top = np.lexsort((words, -n))[:FEATURES]
    feature[top] = np.arange(len(top))
    slots = -(-max(1, len(words)) * 2 * FEATURES // BLOCK_SLOTS) * BLOCK_SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = shared.value, np.zeros(slots, np.uint32)
        for batch in batches:
            for lo, joined, bounds, starts, hashes in hashed_words(batch.column("text")):
                ids = numbered(hashes, np.frombuffer(joined, np.uint8)[starts].astype(np.int64), known)
                at = np.searchsorted(starts, bounds)
                is_rare = ids >= len(known)
                rare_at = np.concatenate([[0], np.cumsum(is_rare)])[at]
                beside = np.ones(max(0, len(ids) - 1), bool)
                inner = at[1:-1]
                beside[inner[(inner > 0) & (inner < len(ids))] - 1] = False
                of, left, right = ids.astype(np.int64), feature[ids[:-1]], feature[ids[1:]]
                a, b = beside & (left >= 0) & ~is_rare[1:], beside & (right >= 0) & ~is_rare[:-1]
                count_into(total, np.concatenate([of[1:][a] * 2 * FEATURES + left[a], of[:-1][b] * 2 * FEATURES + FEATURES + right[b]]).astype(np.uint64))
                packed = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids)])
                rare = pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), pa.array(signed(hashes[is_rare])))
                none = pa.nulls(len(packed))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(packed)), packed, rare, none.cast(pa.int32()), none.cast(pa.binary())], names=["doc_id", "ids", "rare", "block", "counts"])
        blocks = packed_counts(total)
        none = pa.nulls(blocks.num_rows)
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.list_(pa.int64())), *blocks.columns], names=["doc_id", "ids", "rare", "block", "counts"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids binary, rare array<bigint>, block int, counts binary")
    table = stored(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")
    beside = collected_counts(summed_counts(table.filter("block is not null").select("block", "counts"), slots), slots)
    return table.filter("block is null").select("row", "doc_id", "ids", "rare"), beside[: len(words) * 2 * FEATURES].reshape(len(words), 2 * FEATURES)


def word_classes(n: np.ndarray, beside: np.ndarray, alone: int, together: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """The class of each word: the ``alone`` most frequent first, then ``together`` classes by k-means on the
    roots of smoothed neighbour shares, weighted by frequency."""
    order = np.lexsort((np.arange(len(n)), -n))
    found = np.zeros(len(n), np.int64)
    found[order[:alone]] = np.arange(min(alone, len(n)))
    rest = np.sort(order[alone:])
    if not len(rest):
        return found
    x, weight = beside[rest].astype(np.float64), n[rest].astype(np.float64)
    prior = (beside.sum(axis=0) + 1) / (beside.sum() + beside.shape[1])
    x = np.sqrt((x + 4 * prior) / (x.sum(axis=1, keepdims=True) + 4)).astype(np.float32)
    rng, k = np.random.default_rng(seed), min(together, len(rest))
    centres = x[rng.choice(len(rest), k, replace=False, p=weight / weight.sum())]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)
        mass = np.bincount(near, weight, k)
        sums = np.stack([np.bincount(near, weight * x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1)[:, None], centres).astype(np.float32)
    found[rest] = alone + near
    return found


def triples(ids: np.ndarray, ends: np.ndarray, class_of: np.ndarray, classes: int) -> np.ndarray:
    """(left, class, right) of each token as one number; documents end at ``ends``, edges are ``classes``."""
    own = class_of[ids]
    left, right = np.empty_like(own), np.empty_like(own)
    left[1:], right[:-1] = own[:-1], own[1:]
    filled = np.unique(ends[ends > 0])
    right[filled - 1] = classes
    left[np.concatenate([[0], filled[:-1]])[: len(filled)]] = classes
    return (left * classes + own) * (classes + 1) + right


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of documents, and where each of them ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    ids = np.frombuffer(data, np.uint16, (offsets[-1] - offsets[0]) // 2, offsets[0]) if data else np.zeros(0, np.uint16)
    return ids, (offsets[1:] - offsets[0]) // 2


def triple_counts(encoded: DataFrame, class_of: np.ndarray, classes: int) -> np.ndarray:
    """[left, class, right]: how often each class stands between each two in the corpus."""
    cells = (classes + 1) * classes * (classes + 1)
    slots = -(-cells // BLOCK_SLOTS) * BLOCK_SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            ids, ends = _flat(batch.column("ids"))
            if len(ids):
                count_into(total, triples(ids, ends, class_of, classes).astype(np.uint64))
        yield packed_counts(total)

    packed = encoded.select("ids").mapInArrow(run, "block int, counts binary")
    return collected_counts(summed_counts(packed, slots), slots)[:cells].reshape(classes + 1, classes, classes + 1)


class Window:
    """Parameters: left and right [classes + 1, hidden], out [hidden, classes], bias [classes]."""

    def __init__(self, classes: int, hidden: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.left, self.right, self.out, self.bias = draw(classes + 1, hidden), draw(classes + 1, hidden), draw(hidden, classes), np.zeros(classes, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.left, self.right, self.out, self.bias]

    def log_probabilities(self) -> tuple[np.ndarray, np.ndarray]:
        """[left, right, hidden] and [left, right, class]: of every class between every two neighbours."""
        hidden = np.tanh(self.left[:, None, :] + self.right[None, :, :])
        logits = hidden @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        return hidden, logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))

    def gradients(self, seen: np.ndarray) -> list[np.ndarray]:
        """Of the mean log-loss over tokens counted in ``seen`` [left, right, class]."""
        hidden, logs = self.log_probabilities()
        error = (np.exp(logs) * seen.sum(axis=2, keepdims=True) - seen) / np.float32(max(1.0, seen.sum(dtype=np.float64)))
        back = (error @ self.out.T) * (1 - hidden * hidden)
        flat = error.reshape(-1, error.shape[2])
        return [back.sum(axis=1), back.sum(axis=0), hidden.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)]

    def train(self, counts: np.ndarray, steps: int, rate: float = 0.05) -> Window:
        """Adam on all counts [left, class, right] at once, from the classes' frequencies on."""
        seen = np.ascontiguousarray(counts.transpose(0, 2, 1), np.float32)
        self.bias[:] = np.log(seen.sum(axis=(0, 1), dtype=np.float64) + 0.5) - np.log(max(1.0, seen.sum(dtype=np.float64)))
        means, squares = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        for t in range(1, steps + 1):
            pace = rate * min(1.0, 2 * (steps - t + 1) / steps)
            for p, g, m, s in zip(self.parameters(), self.gradients(seen), means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= pace * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        return self


class Model:
    """What scoring needs: ``words`` with ids, the class of each id, log-shares, the table of log-probabilities;
    and ``counts``, Spark's table of all words."""

    def __init__(self, counts: DataFrame, words: np.ndarray, class_of: np.ndarray, classes: int, shares: np.ndarray, table: np.ndarray):
        self.counts, self.words, self.class_of, self.classes, self.shares, self.table = counts, words, class_of, classes, shares, table


def learn(docs: DataFrame, vocabulary: int = 48_000, alone: int = 32, together: int = 80, hidden: int = 24, steps: int = 120) -> tuple[Model, DataFrame]:
    """The model of all documents, and the documents encoded by it."""
    counts = stored(word_counts(docs), "word-counts")
    words, n = most_frequent(counts, vocabulary)
    encoded, beside = encode(docs, words, n)
    classes = alone + together + SHAPES
    class_of = np.concatenate([word_classes(n, beside, alone, together), alone + together + np.arange(SHAPES)])
    seen = triple_counts(encoded, class_of, classes)
    mass = np.maximum(1.0, seen.sum(axis=(0, 2), dtype=np.float64))
    # a rare word's own count is added by the join
    shares = np.concatenate([np.log(n), np.zeros(SHAPES)]) - np.log(mass[class_of])
    logs = Window(classes, hidden).train(seen, steps).log_probabilities()[1]
    return Model(counts, words, class_of, classes, shares, np.ascontiguousarray(logs.transpose(0, 2, 1)).ravel()), encoded


def score(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, sum_log_probability, mean_log_probability of every encoded row."""
    shared = encoded.sparkSession.sparkContext.broadcast((model.class_of, model.classes, model.shares, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, classes, shares, table = shared.value
        for batch in batches:
            ids, ends = _flat(batch.column("ids"))
            sizes, total = np.diff(ends, prepend=0), np.zeros(len(ends))
            if len(ids):
                logs = table[triples(ids, ends, class_of, classes)].astype(np.float64) + shares[ids]
                total[sizes > 0] = np.add.reduceat(logs, (ends - sizes)[sizes > 0])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(total)], names=["row", "doc_id", "n_tokens", "total"])

    known = encoded.select("row", "doc_id", "ids").mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, total double")
    # logs of rare words' counts as whole millionths, so that their sum has no order
    each = encoded.select("row", F.explode("rare").alias("word"))
    logs = model.counts.filter("n > 1").select("word", F.round(F.log("n") * 1_000_000).cast("bigint").alias("millionths"))
    rare = each.join(logs.hint("shuffle_merge"), "word").groupBy("row").agg(F.sum("millionths").alias("millionths"))
    both = known.join(rare.hint("shuffle_merge"), "row", "left")
    total = F.col("total") + F.coalesce("millionths", F.lit(0)) / 1_000_000
    return both.select("doc_id", "n_tokens", F.round(total, 4).alias("sum_log_probability"), F.round(total / F.nullif("n_tokens", F.lit(0)), 6).alias("mean_log_probability"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The scores of other documents than those that the model has learned from."""
    return score(encode(docs, model.words, np.zeros(len(model.words), np.int64))[0], model)


def pseudo_likelihoods(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_tokens, sum_log_probability, mean_log_probability of every row, by a model of them all."""
    model, encoded = learn(docs, **settings)
    return score(encoded, model)
