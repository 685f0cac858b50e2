"""Cutting text where every byte-level pre-tokenizer of the GPT-2 kind cuts too.

The pattern ``'s|..| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` starts a match at every
single space that has a character other than white space on both sides: the match before it cannot
contain the space, and the space is the optional prefix of the match after it.  A single newline between
two such characters is a match of its own.  A text without other white space, the usual kind, is thus cut
at its spaces and newlines into chunks whose encodings can be joined; equal chunks need encoding once.
Arrow cuts a column of texts, numbers its distinct chunks and puts their ids together again, so Python
sees each new chunk once.  Any other text goes to ``whole``, one at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space at an edge of the text or beside other white space, or of another kind than space and
#: newline.  RE2's \\s is ASCII only, so Unicode's spaces and separators are listed; a text that matches
#: without need only takes the slower way.
_IRREGULAR = "^[ \\n]|[ \\n]$|[ \\n][ \\n]|[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _sliced(texts: pa.Array, slice_bytes: int):
    """Slices of about ``slice_bytes``; a longer text has one of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // slice_bytes
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield texts.slice(a, b - a)


class Encoder:
    """Columns of texts to ids, with a bounded memory of chunks in each Python worker.

    ``encode`` gives the ids of each of a list of chunks, which begin a line where a newline is their first
    character and follow a space otherwise; ``whole`` gives those of one text; ``newline`` is the
    id of a newline.  ``apart`` lists strings whose texts go to ``whole``.  A memory that reaches
    ``limit`` chunks starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], pa.ListArray], whole: Callable[[str], list[int]], newline: int, apart: tuple[str, ...] = (), limit: int = 400_000):
        self.encode, self.whole, self.newline, self.apart, self.limit = encode, whole, newline, apart, limit
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = pa.array([], pa.list_(pa.int32()))

    def _numbers(self, chunks: pa.StringArray) -> pa.Array:
        """The place in memory of each of some distinct chunks; new ones are encoded."""
        at = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(at.is_null())
        if not len(new):
            return at
        if len(self.known) + len(new) > self.limit:
            self._forget()
            new, at = chunks, None
        base = len(self.known)
        self.known = pa.concat_arrays([self.known, new])
        self.ids = pa.concat_arrays([self.ids, self.encode(new.to_pylist())])
        if at is None:
            return pa.array(np.arange(len(new), dtype=np.int32))
        places = at.to_numpy(zero_copy_only=False).astype(float)
        places[np.isnan(places)] = base + np.arange(len(new))
        return pa.array(places.astype(np.int32))

    def _regular(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each text.  Lines are marked by the newline before them, and the
        first line gets one too, whose id is taken out again."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        places = self._numbers(coded.dictionary)
        taken = self.ids.take(places.take(coded.indices))
        flat = taken.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.diff(taken.offsets.to_numpy()))])
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        keep = np.ones(len(flat), bool)
        keep[bounds[:-1]] = False
        return flat[keep], np.diff(bounds) - 1

    def encode_column(self, column: pa.Array, slice_bytes: int = 8 << 20):
        """(flat ids as int32, number of ids of each text) of some texts at a time; none for null."""
        texts = pc.fill_null(column.cast(pa.string()), "")
        for part in _sliced(texts, slice_bytes):
            odd = pc.match_substring_regex(part, _IRREGULAR)
            for mark in self.apart:
                odd = pc.or_(odd, pc.match_substring(part, mark))
            if not pc.any(odd).as_py():
                yield self._even(part)
                continue
            odd_at = odd.to_numpy(zero_copy_only=False)
            flat, sizes = self._even(part.filter(pc.invert(odd)))
            own = [np.array(self.whole(t), np.int32) for t in part.filter(odd).to_pylist()]
            n = np.zeros(len(part), np.int64)
            n[~odd_at], n[odd_at] = sizes, [len(x) for x in own]
            which = np.repeat(odd_at, n)
            ids = np.empty(len(which), np.int32)
            ids[~which], ids[which] = flat, np.concatenate(own)
            yield ids, n

    def _even(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        filled = pc.not_equal(texts, "")
        if pc.all(filled).as_py():
            return self._regular(texts)
        at = filled.to_numpy(zero_copy_only=False)
        n = np.zeros(len(texts), np.int64)
        flat, n[at] = self._regular(texts.filter(filled))
        return flat, n


_MARKS = frozenset(".,;:!?\"()")


def by_pieces(find: Callable[[str], list[str]], ids_of: Callable[[str], list[int]], newline: int, limit: int = 400_000, longest: int = 40) -> Callable[[list[str]], pa.ListArray]:
    """An ``encode`` for Encoder: ``find`` cuts a chunk into pieces, the pattern's matches, and ``ids_of``
    encodes one.  Pieces are remembered up to ``limit``, long ones not at all."""
    pieces: dict[str, list[int]] = {}

    def piece(x: str) -> list[int]:
        ids = pieces.get(x)
        if ids is None:
            ids = ids_of(x)
            if len(x) <= longest:
                pieces[x] = ids
        return ids

    def chunk(c: str) -> list[int]:
        body = c[1:] if c[0] == " " else c
        if body.isalpha():  # letters only: the pattern takes them whole
            return piece(c)
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return piece(c[:-1]) + piece(body[-1])
        return [i for x in find(c) for i in piece(x)]

    def encode(chunks: list[str]) -> pa.ListArray:
        found = [chunk(" " + c) if c[0] != "\n" else [newline, *chunk(c[1:])] if len(c) > 1 else [newline] for c in chunks]
        if len(pieces) > limit:
            pieces.clear()
        return pa.array(found, pa.list_(pa.int32()))

    return encode
