"""Byte-level BPE by backtracking.

Token bytes are mapped to Latin-1, one character a byte, so that the trie of an
Aho-Corasick automaton over strings tells at any place of a piece how far tokens can
reach there, and which there are.  A sequence of tokens is what BPE's merges give exactly
when each neighbouring pair is: taking the merges of the two back, latest first, meets
none across their seam that was due before.  So the encoder takes the longest
token that is compatible with the one before it, and steps back where none is; a
position once found a dead end is never entered again, for at most one valid token
sequence leads to it.  That is linear in the piece.  Pair tests are memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.textkernel import slices

_CACHE, _CACHED_BYTES, _PAIRS = 400_000, 64, 200_000
_GAPS = regex.compile(r"\s{2,}")


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64(token) rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class Codec:
    """Ranks and the pattern of pieces.

    ``by_word``: no piece goes on from what is no white space into a space, so texts may be
    cut there; False for a pattern that has such pieces.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, by_word: bool = True):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.by_word = by_word
        self.bytes = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}  # what a token's last merge joins
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.longest = max(map(len, ranks), default=1)
        for token, rank in ranks.items():
            parts = self.merge(token, 2)
            if len(token) == 1 or len(parts) == 2 and parts[0] + parts[1] == token:  # others never come out of merges
                self.automaton.add_word(token.decode("latin-1"), rank)
                if len(token) > 1:
                    self.halves[rank] = ranks[parts[0]], ranks[parts[1]]
        self.automaton.make_automaton()
        self.cache = _Cache(lambda piece: self.encode_piece(piece.encode()))
        self.words = _Cache(lambda word: self.pieces(" " + word))

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """The merges themselves, lowest rank first, until ``least`` parts are left; only tokens come here."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > least:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1))
            if best == 1 << 31:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            found = self._compatible(a, b)
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Merges are taken back, the latest first; what then meets at the seam must not have been due before it.

        Of equal ranks the left one is merged first: so it is taken back last, and one across
        the seam comes before the right token's merge but after the left token's.
        """
        ranks, bytes_, halves, due = self.ranks, self.bytes, self.halves, 1 << 31
        while True:
            if ranks.get(bytes_[a] + bytes_[b], due) < due:
                return False
            if a in halves and (a > b or b not in halves):
                due, a = a, halves[a][1]
            elif b in halves:
                due, b = b + 1, halves[b][0]
            else:
                return True

    def encode_piece(self, data: bytes) -> bytes:
        """The ids of one piece, as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(data)
        return np.array([whole] if whole is not None else self._backtracked(data), "<u4").tobytes()

    def _backtracked(self, data: bytes) -> list[int]:
        text, n, longest = data.decode("latin-1"), len(data), self.longest
        get, reach, compatible = self.automaton.get, self.automaton.longest_prefix, self.compatible
        alive, taken = bytearray(b"\1" * (n + 1)), []
        pos, before, size = 0, -1, reach(text[:longest])
        while pos < n:
            while size:
                token = get(text[pos : pos + size], None) if alive[pos + size] else None
                if token is not None and (before < 0 or compatible(before, token)):
                    break
                size -= 1
            if size:
                taken.append((pos, size, token, before))
                pos, before = pos + size, token
                size = reach(text[pos : pos + longest])
            else:
                alive[pos] = 0
                pos, size, _, before = taken.pop()
                size -= 1
        return [token for _, _, token, _ in taken]

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers.

        Before a single space between what is none, the text may be cut; words so cut are
        looked up whole.  Around longer white space, the words on both sides stay with it.
        """
        out, at, gaps = [], 0, [m.span() for m in _GAPS.finditer(text)] if self.by_word else [(0, len(text))]
        k = 0
        while k < len(gaps):
            begin = text.rfind(" ", at, gaps[k][0])
            begin = at if begin < 0 else begin
            end = text.find(" ", gaps[k][1])
            while k + 1 < len(gaps) and (end < 0 or gaps[k + 1][0] <= end):
                k += 1
                end = text.find(" ", gaps[k][1])
            end, k = len(text) if end < 0 else end, k + 1
            out += [self._worded(text[at:begin]), self.pieces(text[begin:end])]
            at = end
        out.append(self._worded(text[at:]))
        return b"".join(out)

    def _worded(self, text: str) -> bytes:
        first, *words = text.split(" ")
        return self.pieces(first) + b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids so written; an unknown id raises ``KeyError``."""
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I")))


class _Cache(dict):
    """Encoded ids by piece or word, up to a bound; beyond it, and for long ones, they are made anew."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) <= _CACHED_BYTES and len(self) < _CACHE:
            self[text] = ids
        return ids


_codecs: dict[str, Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec a worker process for each vocabulary."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(raw), pattern)
    return _codecs[key]


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) for every row: the whole text's token ids and what these decode to.

    ``vocabulary`` is the path of a rank file on the driver; the ranks, a fixed table, are
    broadcast.  ``ids``: little-endian unsigned 32-bit integers in one binary; ``decoded``:
    bytes.  Null and empty texts: no ids.  Other columns are not read; repeated rows are
    all returned; an empty table gives no rows.
    """
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value, pattern)
        for batch in batches:
            for at, texts in slices(batch, "text"):
                ids = [own.encode(t.decode()) for t in texts]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                columns = [batch.column(0).slice(at, len(texts)), n, pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded binary")
    return found.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids); see :func:`round_trip`."""
    return round_trip(docs, vocabulary, pattern, id_col, text_col).drop("decoded")
