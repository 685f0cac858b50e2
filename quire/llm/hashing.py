"""Words and word windows as 64-bit hashes, many documents at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_MIX1, _MIX2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


class WordHashes:
    """word -> hash, remembered up to a limit by each Python worker."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.known = limit, {}

    def digest(self, word: str) -> int:
        return xxhash.xxh3_64_intdigest(word.encode())

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = set(words) - known.keys()
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set(words)
            known.update([(w, self.digest(w)) for w in new])
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _MIX1
    x = (x ^ (x >> _S33)) * _MIX2
    return x ^ (x >> _S33)


_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_GAP_BYTE = re.compile(rb"[\x20\x09-\x0d]")
_FOLDED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_BASE = int(_STEP | np.uint64(1))
_TABLES: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base from 1 on, and of its inverse from 0 on."""
    if len(_TABLES[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        _TABLES[:] = np.cumprod(up), np.cumprod(down)
    return _TABLES


class Alphabet:
    """What separates words, and the value of each byte: ``folded`` bytes count as their image."""

    def __init__(self, gap: np.ndarray, folded: np.ndarray):
        self.gap, self.value = gap, mix(_STEP * (folded + 1).astype(np.uint64))


#: Words between white space, A-Z lower-cased.
PLAIN = Alphabet(_GAP, _FOLDED)


def bytes_hashed(data: np.ndarray, alphabet: Alphabet = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in ``data``: a polynomial in its bytes, folded, and mixed.
    Running sums over all bytes give each word's by a difference, and the inverse power of its start
    makes it that of the word alone."""
    inside = ~alphabet.gap[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edges = np.concatenate([[0], edges])
    if len(edges) % 2:
        edges = np.append(edges, len(data))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts.astype(np.int64), np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(alphabet.value[data] * up[: len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def hashed_words(column: pa.Array, slice_bytes: int = 1 << 18, alphabet: Alphabet = PLAIN) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a column of texts, ``[^\\x20\\x09-\\x0D]+`` or those of another alphabet, as hashes, some texts at a time.

    Yields the first text's number, the texts' UTF-8 joined by spaces, where each of them starts in it
    (and one more), where each word starts, and its hash.  Texts are never cut between two slices; a
    text longer than a slice is hashed a piece at a time.
    """
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    slice_of = (np.cumsum(sizes) - sizes) // slice_bytes
    cuts = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:]):
        joined = b" ".join(texts[lo:hi])
        bounds = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
        starts, hashes, at = [], [], 0
        while at < len(joined):
            gap = _GAP_BYTE.search(joined, at + slice_bytes)
            end = gap.start() if gap else len(joined)
            found, values = bytes_hashed(np.frombuffer(joined, np.uint8, end - at, at), alphabet)
            starts.append(found + at)
            hashes.append(values)
            at = end
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        yield lo, joined, bounds, whole(starts, np.int64), whole(hashes, np.uint64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all windows of ``size`` words; a shorter sequence is one window."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = mix(total * _STEP + hashes[k : n - width + 1 + k])
    return np.unique(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
