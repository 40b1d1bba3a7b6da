"""Vectorised byte kernels shared by the document operators.

Everything here works on one bounded slice of documents at a time (see
:func:`slices`), as NumPy arrays over the slice's UTF-8 bytes.  A slice is cut
by bytes, not by rows, so that a run of very long documents cannot grow the
working set; one document longer than the bound is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20

#: Bytes of words in the plain sense: all but ASCII white space (space, and tab to carriage return).
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words in the wide sense: ASCII digits and letters, all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_LONG = 512


def payloads(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive slices of at most ``limit`` bytes, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    n = len(column)
    if not n:
        return
    sizes = np.fromiter((len(x) if x is not None else 0 for x in column.cast(pa.binary()).to_pylist()), np.int64, n)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, payloads(column.slice(at, to - at))
        at = to


class Words:
    """Words of a slice: ``norm`` holds them lower-cased (A-Z) with one space after each.

    ``start``/``size`` give each word's place in ``norm``; the words of document
    ``d`` are ``first[d]`` to ``first[d + 1]``.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        raw = np.frombuffer(b"\n".join(texts) + b"\n" + b"\0" * 8, np.uint8)[:-8]
        sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        docs = np.concatenate(([0], np.cumsum(sizes)))
        word = is_word[raw]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
        begin, end = edge[0::2], edge[1::2]
        keep = word.copy()
        keep[end] = True
        lowered = LOWER[raw]
        lowered[~word] = 0x20
        self.norm = np.concatenate((lowered[keep], np.zeros(8, np.uint8)))
        self.size = end - begin
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.first = np.searchsorted(begin, docs)
        self.n_docs = len(texts)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, first): k-word runs as spans of ``norm``, and where each document's begin.

        A document of fewer than ``k`` words has one run, all of its words; one
        without words has none.
        """
        n = np.diff(self.first)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], count)
        last = at + np.repeat(np.minimum(n, k), count) - 1
        return self.start[at], self.start[last] + self.size[last] - self.start[at], first


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * _P2, 31) * _P1


def xxh64(norm: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of ``norm`` (which has eight bytes to spare at its end), unsigned.

    Spans are taken length by length, so that every step is one array operation.
    """
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    data = norm.tobytes()
    wide = np.ndarray((len(norm) - 7,), "<u8", data, strides=(1,))
    half = np.ndarray((len(norm) - 3,), "<u4", data, strides=(1,))
    big = np.flatnonzero(size > _LONG)
    for i in big:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]], seed)
    short = np.where(size > _LONG, _LONG + 1, size).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    bounds = np.searchsorted(short[order], np.arange(_LONG + 2))
    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        for n in np.flatnonzero(np.diff(bounds)):
            rows = order[bounds[n] : bounds[n + 1]]
            at, n = start[rows], int(n)
            left = n
            if n >= 32:
                v = [np.full(len(at), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
                while left >= 32:
                    for j in range(4):
                        v[j] = _round(v[j], wide[at + 8 * j])
                    at, left = at + 32, left - 32
                h = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
                for j in range(4):
                    h = (h ^ _round(np.uint64(0), v[j])) * _P1 + _P4
            else:
                h = np.full(len(at), seed + _P5, np.uint64)
            h = h + np.uint64(n)
            while left >= 8:
                h = _rotate(h ^ _round(np.uint64(0), wide[at]), 27) * _P1 + _P4
                at, left = at + 8, left - 8
            if left >= 4:
                h = _rotate(h ^ (half[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
                at, left = at + 4, left - 4
            while left:
                h = _rotate(h ^ (norm[at].astype(np.uint64) * _P5), 11) * _P1
                at, left = at + 1, left - 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


_LANES = np.uint64(0x0101010101010101)


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of runs of ``hashes``: a bit is 1 if set in over half of its run; empty: 0.

    Bits are counted eight at a time: bit ``b`` of every byte of a hash adds to the
    byte lanes of one word, over stretches of at most 255 hashes.
    """
    n = np.diff(first)
    parts = -(-n // 255)
    of = np.concatenate(([0], np.cumsum(parts)))
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if not some.any():
        return out
    cut = np.repeat(first[:-1], parts) + 255 * (np.arange(of[-1]) - np.repeat(of[:-1], parts))
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, cut)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of[:-1][some])
        over = (2 * sums > n[some, None]).astype(np.uint64)
        out[some] |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(b))).sum(1, dtype=np.uint64)
    return out
