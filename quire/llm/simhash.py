r"""SimHash near-duplicates by an exact comparison of tiles.

A text's words are what stands between white space, A-Z lower-cased; each run of ``size`` words, repeats
included, is hashed as UTF-8 by XXH64, and a bit of the fingerprint is 1 where more than half of the hashes
have it.  Two fingerprints that differ in at most ``radius`` bits are linked.

1. Each document gets its fingerprint; equal ones are one member from here on, so copies cost nothing.
2. Distinct fingerprints are dealt by range, in the order of their population count, then of those of their
   first half and of two of their quarters, into tiles of about ``tile`` members.  A tile is one row: its
   members packed, and the least and greatest population count of the whole, the halves and the quarters.
   Its members are compared among themselves where it is made.
3. Fingerprints that differ in r bits differ by at most r in population count, and so do the differences
   of their halves' or quarters' counts added up.  Pairs of tiles farther apart than the radius are
   never made; the others become a row each, and a task compares two tiles, sub-tile by sub-tile, with an
   exclusive-or and a bit count, skipping pairs of sub-tiles in the same way.
4. A tile's members are first joined into the tile's own components, and a pair of tiles returns only links
   that join two of them: a forest, so a cluster of any size gives no more links than members and
   tile pairs.  Components of all links name the groups.

Nothing is skipped that could be within the radius, so links are exact; the number of comparisons grows with
the square of the number of distinct fingerprints, divided by what the population counts rule out.  A task
holds two tiles.  Lost tasks are run again on tables in the shared folder.

Edge cases: a null text, an empty one and one without words have the fingerprint 0 and are linked like any
other.  Fewer words than ``size`` are hashed as one sequence.  Very long texts are hashed a piece at a time.
Rows that repeat are members of the same group.  A null id takes part and names no group, unless the group has
no other: then component_id is null.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_stored, stored
from .components import components
from .hashing import mix, signed

SEED = 42
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = np.arange(8) * 256
#: Rows and columns of a block that is compared at once, a sub-tile's length being the rows.
SUB, WIDE = 256, 1024


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the least first."""
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BYTE_BITS).ravel()


def fingerprint(text: str | None, size: int = 4, piece: int = 1 << 20) -> int:
    """The 64-bit fingerprint of a text."""
    data = (text or "").encode().lower()
    digest, counts, n, held, at = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, [], 0
    while at < len(data):
        gap = _GAP.search(data, at + piece)
        end = gap.start() if gap else len(data)
        words = held + data[at:end].split()
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        if len(words) >= size:
            starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
            counts += bit_counts(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64))
            n += len(starts)
        held, at = words[-(size - 1) :] if size > 1 else [], end
    if not n and held:
        return digest(b" ".join(held), SEED)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits) and v, a scrambled name of it, one for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed(prints)), pa.array(signed(mix(prints)))], names=["doc_id", "fp", "v"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint, v bigint")


def _populations(prints: np.ndarray) -> np.ndarray:
    """Population counts of the whole, the two halves and the four quarters, a column each."""
    quarters = np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    halves = quarters[:, ::2] + quarters[:, 1::2]
    return np.column_stack([halves.sum(axis=1, dtype=np.int16), halves, quarters])


def _ordered(prints: np.ndarray) -> np.ndarray:
    p = _populations(prints)
    return prints[np.lexsort((prints, p[:, 5], p[:, 3], p[:, 1], p[:, 0]))]


def _boxes(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest counts of each sub-tile of ``SUB`` members."""
    p, at = _populations(prints), np.arange(0, len(prints), SUB)
    return np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)


def _far(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray, radius: int) -> np.ndarray:
    """Which of some boxes are farther than the radius from one."""
    apart = np.maximum(0, np.maximum(lo - his, los - hi))
    return np.maximum(apart[:, 0], np.maximum(apart[:, 1:3].sum(axis=1), apart[:, 3:].sum(axis=1))) > radius


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray, links: list) -> None:
    """Join the components of a and b; ``links`` gets the pairs that joined two.  label[x] <= x is a root."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        high, first = np.unique(np.maximum(la, lb)[apart], return_index=True)
        low = np.minimum(la, lb)[apart][first]
        links.append(np.column_stack([high, low]))
        label[high] = low
        while not np.array_equal(up := label[label], label):
            label[:] = up


def join_tiles(x: np.ndarray, y: np.ndarray | None, label: np.ndarray, radius: int) -> np.ndarray:
    """Links (places in x followed by y) that join components of ``label``, which are joined in it: those
    between x and y, or inside x without y."""
    other, shift = (x, 0) if y is None else (y, len(x))
    (los, his), (olos, ohis) = _boxes(x), _boxes(other)
    links: list[np.ndarray] = []
    room, bits = np.empty((SUB, WIDE), np.uint64), np.empty((SUB, WIDE), np.uint8)
    for i, lo in enumerate(range(0, len(x), SUB)):
        rows = x[lo : lo + SUB, None]
        near = np.flatnonzero(~_far(los[i], his[i], olos, ohis, radius))
        if y is None:
            near = near[near >= i]
        if not len(near):
            continue
        at = (near[:, None] * SUB + np.arange(SUB)).ravel()
        at = at[at < len(other)]
        for c in range(0, len(at), WIDE):
            part = at[c : c + WIDE]
            differ = np.bitwise_xor(rows, other[part][None, :], out=room[: len(rows), : len(part)])
            found = np.flatnonzero((np.bitwise_count(differ, out=bits[: len(rows), : len(part)]) <= radius).ravel())
            if len(found):
                _hook(label, lo + found // len(part), shift + part[found % len(part)], links)
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


_TILE = "tile int, lo array<int>, hi array<int>, prints binary, roots binary"


def tiles(prints: DataFrame, tile: int, radius: int) -> DataFrame:
    """A row for each tile of the distinct fingerprints ``fp``, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(b.column("fp")).view(np.uint64) for b in batches]
        if not sum(map(len, parts)):
            return
        held = _ordered(np.concatenate(parts))
        label = np.arange(len(held))
        join_tiles(held, None, label, radius)
        p = _populations(held)
        box = lambda v: pa.array([v.tolist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), box(p.min(axis=0)), box(p.max(axis=0)), pa.array([held.tobytes()], pa.binary()), pa.array([label.astype(np.int32).tobytes()], pa.binary())], names=["tile", "lo", "hi", "prints", "roots"])

    distinct = stored(prints.select("fp").distinct(), "prints")
    part = lambda bits, at: F.bit_count(F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1))
    order = [F.bit_count("fp"), part(32, 0), part(16, 0), part(16, 32), F.col("fp")]
    dealt = distinct.repartitionByRange(max(1, -(-distinct.count() // tile)), *order)
    made = stored(dealt.mapInArrow(run, _TILE), "tiles")
    drop_stored(distinct)
    return made


def tile_pairs(made: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b: tiles whose population counts are within the radius.  They meet by each count of the whole
    that the lesser one can have, at its least meeting count only."""
    side = lambda x: made.select(F.col("tile").alias(x), *[F.col(c)[i].alias(f"{x}{c}{i}") for i in range(7) for c in ("lo", "hi")])
    a = side("a").withColumn("at", F.explode(F.sequence("alo0", "ahi0")))
    b = side("b").withColumn("at", F.explode(F.sequence(F.col("blo0") - radius, F.col("bhi0") + radius)))
    apart = lambda i: F.greatest(F.lit(0), F.col(f"alo{i}") - F.col(f"bhi{i}"), F.col(f"blo{i}") - F.col(f"ahi{i}"))
    near = (apart(0) <= radius) & (apart(1) + apart(2) <= radius) & (apart(3) + apart(4) + apart(5) + apart(6) <= radius)
    met = a.join(b.hint("shuffle_merge"), "at").filter((F.col("a") < F.col("b")) & (F.col("at") == F.greatest("alo0", F.col("blo0") - radius)) & near)
    return met.select("a", "b")


def links(made: DataFrame, radius: int) -> DataFrame:
    """(a, b): names of fingerprints whose links make all components."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, roots in zip(batch.column("prints"), batch.column("roots")):
                names, roots = mix(np.frombuffer(held.as_buffer(), np.uint64)), np.frombuffer(roots.as_buffer(), np.int32)
                at = np.flatnonzero(roots != np.arange(len(roots)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(names[at])), pa.array(signed(names[roots[at]]))], names=["a", "b"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[row].as_buffer(), np.uint64) for c in ("x", "y"))
                rx, ry = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in ("rx", "ry"))
                found = join_tiles(x, y, np.concatenate([rx.astype(np.int64), ry.astype(np.int64) + len(x)]), radius)
                names = signed(mix(np.concatenate([x, y])))
                yield pa.RecordBatch.from_arrays([pa.array(names[found[:, 0]]), pa.array(names[found[:, 1]])], names=["a", "b"])

    own = made.mapInArrow(inside, "a bigint, b bigint")
    side = lambda t, p, r: made.select(F.col("tile").alias(t), F.col("prints").alias(p), F.col("roots").alias(r)).hint("shuffle_merge")
    pairs = stored(tile_pairs(made, radius), "tile-pairs")
    # a pair is one row that stands for much work: a task gets about two
    both = pairs.join(side("a", "x", "rx"), "a").join(side("b", "y", "ry"), "b").repartition(max(1, -(-pairs.count() // 2)), "a", "b")
    return own.union(both.mapInArrow(between, "a bigint, b bigint"))


def simhash_groups(docs: DataFrame, size: int = 4, radius: int = 4, tile: int = 16_384) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    named = stored(fingerprints(docs, size), "fingerprints")
    made = tiles(named, tile, radius)
    roots = components(links(made, radius))
    # a hot fingerprint is one row on the right, and adaptive execution splits its documents on the left
    ids = named.groupBy("v").agg(F.min("doc_id").alias("least")).join(roots.hint("shuffle_merge"), "v", "left").select("v", "least", F.coalesce("root", "v").alias("root"))
    ids = stored(ids, "members")
    groups = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = stored(ids.join(groups.hint("shuffle_merge"), "root").select("v", "component_id"), "groups")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return named.join(groups.hint("shuffle_merge"), "v").select("doc_id", text.alias("fingerprint"), "component_id")
