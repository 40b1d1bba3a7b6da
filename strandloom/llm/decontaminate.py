"""Benchmark passages in documents.

A window has as many words as a benchmark item.  Two runs of ``a`` and ``m`` shingles
have a weighted Jaccard similarity of ``s`` or more only if they share at least
``s / (1 + s) * (a + m)``, so windows are made wherever that many shingles of the item
stand, at whatever offsets: their order does not count for the similarity, and no other
window can reach it.  Windows and items have SimHash fingerprints.  Items are indexed by
size, and those of one size by four blocks of 16 bits: two fingerprints within ``radius``
differ in at most ``radius // 4`` bits in one of the blocks, so every item of that size
within the radius is found.  Of unrelated fingerprints at a radius of 23, 36 % have such a
block and 2 % are within the radius; these are candidates.  Candidates are verified by the exact weighted Jaccard similarity of
their shingles (a shingle weighs as often as it occurs).

At a similarity of 0.8 a bit of the two fingerprints differs with a probability of
about 0.15, so about 10 of 64 bits do; the default radius of 23 is 4.5 standard
deviations above that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.textkernel import ALNUM, Words, simhash, slices, xxh64

_BLOOM = 1 << 20
_WINDOWS = 4096
_POSTINGS = 1 << 21  # places of items' shingles that are looked at together
_CELLS = 1 << 20  # windows by items that are


class Index:
    """A block of benchmark items, ready to be searched for in documents."""

    def __init__(self, ids: list, texts: list[bytes], shingle: int, similarity: float, radius: int):
        self.ids, self.similarity, self.radius = ids, similarity, radius
        words = Words(texts, ALNUM)
        self.size = np.diff(words.first)
        self.k = np.minimum(self.size, shingle)
        self.prints = np.zeros(len(texts), np.uint64)
        self.counts: list[Counter] = [Counter() for _ in texts]
        self.anchors = {}
        for k in np.unique(self.k[self.k > 0]).tolist():
            start, length, first = words.shingles(k)
            hashes = xxh64(words.norm, start, length)
            prints = simhash(hashes, first)
            of = np.repeat(np.arange(len(texts)), np.diff(first))
            mine = self.k[of] == k
            order = np.lexsort((of[mine], hashes[mine]))
            held, of = hashes[mine][order], of[mine][order]
            new = np.concatenate(([True], (held[1:] != held[:-1]) | (of[1:] != of[:-1])))
            held, of = held[new], of[new]  # an item once for each of its shingles
            keys, at = np.unique(held, return_index=True)
            bloom = np.zeros(_BLOOM, bool)
            bloom[keys & np.uint64(_BLOOM - 1)] = True
            self.anchors[k] = bloom, keys, np.repeat(np.arange(len(keys)), np.diff(np.append(at, len(held)))) * len(texts) + of
            for i in np.flatnonzero(self.k == k):
                self.prints[i] = prints[i]
                self.counts[i] = Counter(hashes[first[i] : first[i + 1]].tolist())
        order = np.lexsort((np.arange(len(texts)), self.k, self.size))
        self.by_size = {}
        for mine in np.split(order, np.flatnonzero(np.diff(self.size[order])) + 1):
            if len(mine):
                self.by_size[int(self.size[mine[0]])] = mine, self.prints[mine], self.prints[mine].view(np.uint16).reshape(-1, 4)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, float, int]]:
        """(row, item, first word, similarity, Hamming distance): of each row and item the most similar window, the first of equals."""
        words = Words(texts, ALNUM)
        total = np.diff(words.first)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k, (bloom, keys, postings) in self.anchors.items():
            start, length, first = words.shingles(k)
            hashes = xxh64(words.norm, start, length)
            hit = np.flatnonzero(bloom[hashes & np.uint64(_BLOOM - 1)])
            key = np.minimum(np.searchsorted(keys, hashes[hit]), len(keys) - 1)
            same = keys[key] == hashes[hit]
            hit, key = hit[same], key[same]
            doc = np.searchsorted(first, hit, "right") - 1
            for part in self._placed(doc, key, hit - first[doc], postings):
                windows = self._windows(*part, k, total)
                for size in np.unique(windows[:, 1]).tolist():
                    mine = windows[windows[:, 1] == size]
                    step = max(1, min(_WINDOWS, _CELLS // len(self.by_size[size][0])))
                    for i in range(0, len(mine), step):
                        self._compare(mine[i : i + step], k, hashes, first, total, best)
        return [(d, i, begin, s, distance) for (d, i), (s, begin, distance) in sorted(best.items())]

    def _placed(self, doc: np.ndarray, key: np.ndarray, place: np.ndarray, postings: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, place) of every shingle of an item, some whole rows at a time; a row with very many by ranges of items."""
        n = len(self.ids)
        low = np.searchsorted(postings, key * n)
        ends = np.cumsum(np.searchsorted(postings, (key + 1) * n) - low)
        at = 0
        while at < len(doc):
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + _POSTINGS, "right"))
            to = int(np.searchsorted(doc, doc[to], "left")) if to < len(doc) else to
            to = int(np.searchsorted(doc, doc[at], "right")) if to <= at else to
            parts = min(n, 1 + int(ends[to - 1] - base) // _POSTINGS)
            for p in range(parts):
                begin, end = (np.searchsorted(postings, key[at:to] * n + n * x // parts) for x in (p, p + 1))
                many = end - begin
                post = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
                yield np.repeat(doc[at:to], many), postings[post] % n, np.repeat(place[at:to], many)
            at = to

    def _windows(self, doc: np.ndarray, item: np.ndarray, place: np.ndarray, k: int, total: np.ndarray) -> np.ndarray:
        """(row, size, first word) of every window with enough places at which a shingle of one item of that size stands.

        If ``need`` of an item's places, one after the other, span no more than a window, the
        windows that hold them all begin in one stretch; all windows with ``need`` are in such
        a stretch.
        """
        order = np.argsort(doc * len(self.ids) + item, kind="stable")  # places stay in order
        doc, item, place = doc[order], item[order], place[order]
        size = self.size[item]
        n = np.maximum(np.minimum(size, total[doc]) - k + 1, 1)
        need = np.maximum(np.ceil(self.similarity * (n + size - k + 1) / (1 + self.similarity) - 1e-6).astype(np.int64), 1)
        last = np.arange(len(doc)) + need - 1
        end = np.minimum(last, len(doc) - 1)
        fits = (last == end) & (doc[end] == doc) & (item[end] == item) & (place[end] - place < n)
        doc, item, size, n, high, low = doc[fits], item[fits], size[fits], n[fits], place[fits], place[end[fits]]
        low, high = np.maximum(low - n + 1, 0), np.minimum(high, np.maximum(total[doc] - size, 0))
        if len(doc):  # both ends rise within a row and item: what the stretch before has is left out
            after = np.concatenate(([False], (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])))
            low = np.where(after, np.maximum(low, np.concatenate(([0], high[:-1])) + 1), low)
        many = np.maximum(high - low + 1, 0)
        begin = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        return np.unique(np.stack((np.repeat(doc, many), np.repeat(size, many), begin), 1), axis=0)

    def _compare(self, windows: np.ndarray, k: int, hashes: np.ndarray, first: np.ndarray, total: np.ndarray, best: dict) -> None:
        doc, size, begin = windows.T
        n = np.maximum(np.minimum(size, total[doc]) - k + 1, 1)
        ends = np.cumsum(n)
        flat = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first[doc] + begin, n)
        inside = hashes[flat]
        prints = simhash(inside, np.concatenate(([0], ends)))
        items, theirs, blocks = self.by_size[int(size[0])]
        own = prints.view(np.uint16).reshape(-1, 4)
        near = np.zeros((len(prints), len(items)), bool)
        for b in range(4):
            near |= np.bitwise_count(own[:, b, None] ^ blocks[None, :, b]) <= self.radius // 4
        row, at = np.nonzero(near)
        item, distance = items[at], np.bitwise_count(prints[row] ^ theirs[at])
        fits = (self.k[item] == k) & (distance <= self.radius)
        counts: dict[int, Counter] = {}
        for r, i, far in zip(row[fits].tolist(), item[fits].tolist(), distance[fits].tolist()):
            if r not in counts:
                counts[r] = Counter(inside[ends[r] - n[r] : ends[r]].tolist())
            a, b = counts[r], self.counts[i]
            both = sum(min(c, b[h]) for h, c in a.items() if h in b)
            similarity = both / (a.total() + b.total() - both)
            where = (int(doc[r]), i)
            if similarity >= self.similarity and (where not in best or (-similarity, begin[r]) < (-best[where][0], best[where][1])):
                best[where] = similarity, int(begin[r]), far


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, shingle: int, similarity: float, radius: int, block_bytes: int) -> Iterator[Index]:
    """The benchmark in blocks of about ``block_bytes``, each broadcast by its own; one block if it is no larger."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        yield Index([r.item for r in rows], [r.text.encode() for r in rows], shingle, similarity, radius)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 23, block_bytes: int = 8 << 20) -> DataFrame:
    """(id, item, first_word, similarity, distance): every row that has a window like a benchmark item.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z
    lower-cased.  An item or document of fewer than ``shingle`` words has one shingle, all
    its words; items without words match nothing.  One result row for each document row
    and item, with the most similar window, the first of equals; repeated document rows and
    repeated items are all returned.  Null texts are empty; null ids are carried along.
    Empty tables on either side give no rows; other columns are not read.
    The benchmark may be of any size: it is searched for in blocks of ``block_bytes``.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item {item_kind.simpleString()}, first_word long, similarity double, distance int"
    found = []
    for index in _indexes(benchmark, item_col, item_text, shingle, similarity, radius, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for at, texts in slices(batch, "text"):
                    found = index.search(texts)
                    rows, items, begin, same, far = map(list, zip(*found)) if found else ([], [], [], [], [])
                    columns = [batch.column(0).take(pa.array([at + r for r in rows], pa.int64())), pa.array([index.ids[i] for i in items]), pa.array(begin, pa.int64()), pa.array(same, pa.float64()), pa.array(far, pa.int32())]
                    if rows:
                        yield pa.RecordBatch.from_arrays(columns, ["id", "item", "first_word", "similarity", "distance"])

        found.append(source.mapInArrow(run, schema))
    out = reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 23, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs``, all columns, without the rows that :func:`leaks` reports.  No shuffle.

    Rows are judged by their texts alone, so ids may be null or repeated; an empty benchmark drops nothing.
    """
    out = docs
    for index in _indexes(benchmark, item_col, item_text, shingle, similarity, radius, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, texts in slices(batch, text_col):
                    keep[[at + found[0] for found in shared.value.search(texts)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
