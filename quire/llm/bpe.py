r"""Byte-level BPE encoding and decoding by backtracking over longest vocabulary matches.

Bytes are mapped to Latin-1 characters so that pyahocorasick can hold the vocabulary.  A piece (one
match of the pre-tokenizer's pattern) is encoded left to right: take the longest token that starts
here, provided it is compatible with the token before it; where no candidate fits, mark the position
dead, drop the last token and go on with its next shorter candidate.  Two tokens are compatible when
BPE of their joined bytes gives the two back; the answer is memoised.  A sequence of pairwise
compatible tokens is the BPE result itself, and each position turns dead at most once, so a piece takes
time linear in its length (times the longest token).

Edge cases: a null or empty text has no ids and decodes to no bytes.  Any text is encoded whole; lone
surrogates cannot occur in Spark strings.  Repeated rows give repeated results; extra columns are
carried along and keep their names (outputs that clash replace the input's column).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import Encoder, by_pieces

_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class ByteBPE:
    """Encoder and decoder over one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_limit: int = 600_000):
        import ahocorasick
        import regex

        self.ranks, self.memo_limit = ranks, memo_limit
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.joins: dict[tuple[int, int], bool] = {}
        self.reachable: set[bytes] = set()
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or self.merged(token) == [rank]:  # others never come out of BPE
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
                self.reachable.add(token)
        self.automaton.make_automaton()
        find = regex.compile(pattern).findall
        ids_of = lambda piece: self.encode_piece(piece.encode())
        newline = ranks.get(b"\n", 0)
        self.encoder = Encoder(by_pieces(find, ids_of, newline), lambda text: [i for x in find(text) for i in ids_of(x)], newline)
        self.shown = pa.array([self.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)], pa.binary())

    def merged(self, data: bytes) -> list[int]:
        """BPE by repeated merging of the leftmost pair of lowest rank; used on short inputs only."""
        rank, cut = self.ranks.get, list(range(len(data) + 1))
        while len(cut) > 2:
            best, at = min((rank(data[cut[i] : cut[i + 2]], _NONE), i) for i in range(len(cut) - 2))
            if best == _NONE:
                break
            del cut[at + 1]
        return [self.ranks[data[a:b]] for a, b in zip(cut, cut[1:])]

    def compatible(self, left: int, right: int) -> bool:
        answer = self.joins.get((left, right))
        if answer is None:
            if len(self.joins) >= self.memo_limit:
                self.joins.clear()
            answer = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.joins[left, right] = answer
        return answer

    def encode_piece(self, data: bytes) -> list[int]:
        n = len(data)
        if data in self.reachable:
            return [self.ranks[data]]
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            starts[end - length + 1].append((length, token))  # shorter ones end, and come, first
        dead, out, untried, at = bytearray(n + 1), [], [], 0
        left = list(starts[0])
        while at < n:
            while left:
                length, token = left.pop()
                if not dead[at + length] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    untried.append((at, left))
                    at += length
                    left = list(starts[at]) if at < n else []
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a single byte of this text")
                dead[at] = 1
                out.pop()
                at, left = untried.pop()
        return out

    def encode(self, text: str | None) -> list[int]:
        [(ids, _)] = self.encoder.encode_column(pa.array([text], pa.string()))
        return ids.tolist()

    def decode(self, ids) -> bytes:
        return bytes(self.decode_many(np.asarray(ids, np.int32), np.array([len(ids)]))[0])

    def decode_many(self, ids: np.ndarray, sizes: np.ndarray) -> list[memoryview]:
        """The bytes of each document, from flat ids and their number for each; Arrow joins the tokens'."""
        tokens = self.shown.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(tokens.buffers()[1], np.int32, len(ids) + 1, tokens.offset * 4) if len(ids) else np.zeros(1, np.int32)
        data = memoryview(tokens.buffers()[2]).cast("B") if len(ids) else memoryview(b"")
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


_HELD: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """The worker's encoder for a vocabulary file, built once per Python worker."""
    if (path, pattern) not in _HELD:
        _HELD.clear()
        _HELD[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _HELD[path, pattern]


def bpe_roundtrip(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode ``text`` of every row, decode the ids and describe both.

    Adds n_tokens, ids_sha256 and decoded_sha256 to the other columns (text goes unless ``keep_ids``,
    which adds ``ids`` array<int> and keeps text).  One pass, no shuffle: the work is per row.
    ``ranks_path`` must be readable on every executor, as tokenizer packages are.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    carried = [c for c in docs.columns if c not in made]
    out_cols = carried if keep_ids else [c for c in carried if c != "text"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out_cols)
    schema = fields + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            at = 0
            for ids, sizes in bpe.encoder.encode_column(batch.column("text")):
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                packed, ends = memoryview(ids.astype("<u4").tobytes()), (4 * bounds).tolist()
                ids_sha = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
                text_sha = [hashlib.sha256(x).hexdigest() for x in bpe.decode_many(ids, sizes)]
                columns = [batch.column(c).slice(at, len(sizes)) for c in out_cols] + [pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*out_cols, *made])
                at += len(sizes)

    return docs.select(*[f"`{c}`" for c in carried]).mapInArrow(run, schema)
