"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are compared vertically: bit plane ``b`` of 64 fingerprints is one
word, so one XOR tells 64 pairs apart in that bit.  Carry-save counters add the
planes up for all 64 at once, and a block is abandoned as soon as all of its
pairs are over the radius.

Which fingerprints meet: of ``radius + 1`` blocks of the 64 bits, two within the
radius agree in one, and of as many blocks of the remaining bits in one again.
That gives ``(radius + 1) ** 2`` keys for each *distinct* fingerprint (copies fall
together first), of about 28 bits at radius 3.  A key with more than ``slab``
fingerprints is dealt over slabs, and every pair of slabs is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch
from strandloom.llm.components import components
from strandloom.llm.textkernel import NONSPACE, Words, payloads, simhash, slices, xxh64

_CHUNK, _BLOCKS = 1 << 17, 1 << 14
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = 256  # places of a sketch, two bits each
_PAIRS = 0x5555555555555555  # the lower bit of each place
_RUN_ROWS, _RUN_BYTES = 50_000, 6 << 20


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint): the 64-bit SimHash of every whole text, as a signed long.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a feature
    is the XXH64 of ``shingle`` words joined by a space, repeats included.  Fewer words:
    the whole sequence is one feature.  Null, empty and blank texts: 0.  Other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, "text"):
                words = Words(texts, NONSPACE)
                start, size, first = words.shingles(shingle)
                print_ = simhash(xxh64(words.norm, start, size, seed), first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(print_.view(np.int64))], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)


def close_pairs(prints: np.ndarray, run: np.ndarray, radius: int, asks: np.ndarray | bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``i < j`` of the same ``run`` (ids in order) whose prints differ in ``radius`` bits at most, and of which ``i`` is one that ``asks``."""
    n = len(prints)
    if n < 2:
        return
    padded = np.concatenate((prints, np.zeros(-n % 64, np.uint64)))
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    stop = np.searchsorted(run, run, "right")
    probe = np.flatnonzero((stop > np.arange(n) + 1) & asks)
    words = (stop[probe] - 1) // 64 - (probe + 1) // 64 + 1
    ends = np.cumsum(words)
    at = 0
    while at < len(probe):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        i = np.repeat(probe[at:to], words[at:to])
        w = np.arange(len(i)) - np.repeat(ends[at:to] - words[at:to] - base, words[at:to]) + (i + 1) // 64
        at = to
        low, high = np.maximum(i + 1 - 64 * w, 0), np.minimum(stop[i] - 64 * w, 64)
        open_ = (_ALL << low.astype(np.uint64)) & (_ALL >> (64 - high).astype(np.uint64))
        counters = [np.zeros(len(i), np.uint64) for _ in range(radius.bit_length())]
        for b in range(64):
            carry = planes[b, w] ^ (np.uint64(0) - ((prints[i] >> np.uint64(b)) & np.uint64(1)))
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            open_ &= ~carry
            if b % 4 == 3:
                live = np.flatnonzero(open_)
                if not len(live):
                    break
                if 4 * len(live) < 3 * len(i):
                    i, w, open_, counters = i[live], w[live], open_[live], [c[live] for c in counters]
        found = np.flatnonzero(open_)
        for piece in range(0, len(found), _BLOCKS):
            live = found[piece : piece + _BLOCKS]
            block, lane = np.nonzero(np.unpackbits(open_[live].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = i[live][block], 64 * w[live][block] + lane
            near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
            yield a[near], b[near]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` rows, the first row that it is linked with, directly or not."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _keys(fingerprint: Column, radius: int) -> Column:
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    keys = []
    for j, (low, high) in enumerate(zip(cuts, cuts[1:])):
        block = F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        rest = fingerprint.bitwiseAND(F.lit((1 << low) - 1))
        if high < 64:
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fingerprint, high), low))
        width = 64 - (high - low)
        inner = [round(width * i / (radius + 1)) for i in range(radius + 2)]
        for s, (lo, hi) in enumerate(zip(inner, inner[1:])):
            part = F.shiftrightunsigned(rest, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            keys.append(F.shiftleft(block, hi - lo).bitwiseOR(part).bitwiseOR(F.lit((j * (radius + 1) + s) << 56)))
    return F.array(*keys)


def links(prints: DataFrame, radius: int = 3, slab: int = 1024) -> DataFrame:
    """(a, b): edges between distinct ``fingerprint`` values that connect all that are within ``radius``.

    Of the pairs that a group has within the radius, a spanning forest is returned,
    so the rows are at most the group's size.  ``radius``: 1 to 7.
    """
    if not 1 <= radius <= 7:
        raise ValueError("radius must be 1 to 7")
    keyed = prints.select("fingerprint", F.explode(_keys(F.col("fingerprint"), radius)).alias("key"))

    def compare(table: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        prints = table["fingerprint"].to_numpy().view(np.uint64)
        root = _forest(len(prints), close_pairs(prints, run, radius))
        linked = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(prints[root[linked]].view(np.int64)), pa.array(prints[linked].view(np.int64))], ["a", "b"])

    return _deal(keyed, "fingerprint", slab).mapInArrow(lambda batches: _runs(batches, compare), "a long, b long")


def _deal(keyed: DataFrame, member: str, slab: int) -> DataFrame:
    """The rows of every ``key`` that has several, each in a group (key, s, t) with any other of its key at least once.

    A key of more than ``slab`` rows is dealt over slabs by the hash of ``member``.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return (
        keyed.join(sizes, "key")
        .withColumn("slabs", F.ceil(F.col("n") / slab).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64(member), F.col("slabs")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
        .select(*keyed.columns, "mine", F.least("mine", "other").alias("s"), F.greatest("mine", "other").alias("t"))
        .repartition("key", "s", "t")
        .sortWithinPartitions("key", "s", "t")
    )


def _runs(batches: Iterator[pa.RecordBatch], compare: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``compare(rows, run)`` of stretches of whole groups (key, s, t); ``run`` numbers the groups of a stretch."""

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, s, t = (table[c].to_numpy() for c in ("key", "s", "t"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        return compare(table, np.cumsum(new))

    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < _RUN_ROWS and size < _RUN_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key, s, t = (table[c].to_numpy() for c in ("key", "s", "t"))
        last = (key == key[-1]) & (s == s[-1]) & (t == t[-1])
        cut = int(np.argmax(last))
        if cut:
            yield from done(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        rows, size = table.num_rows - cut, sum(x.nbytes for x in held)
    if rows:
        yield from done(pa.Table.from_batches(held).combine_chunks())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, slab: int = 1024) -> DataFrame:
    """(id, fingerprint, component_id) for every row; see :func:`fingerprints` and :func:`links`.

    ``component_id`` is the smallest id among the texts that links lead to, the row's own
    included.  Rows with a null id have a fingerprint and link others like any row; where
    no id but null is reached, the component is null.  Repeated rows are all returned.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, shingle))
    classes = scratch.save(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")))
    roots = components(links(classes, radius, slab), scratch).withColumnRenamed("node", "fingerprint")
    classes = classes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = classes.where("least is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root", "left").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint", "left").select(id_col, "fingerprint", "component_id")


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, in order, and where each document's begin."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(first)))


def _minima(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sketches, some): for each document with hashes (``some``), ``bands`` keys and a sketch.

    Both are made of the least hashes under keyed mixes: a key of ``rows`` of them, a
    sketch of two bits of each of the first ``_SKETCH``, as eight words.
    """
    some = np.flatnonzero(np.diff(first))
    seeds = np.random.default_rng(20240607).integers(0, 1 << 63, (max(bands * rows, _SKETCH), 2), np.uint64)
    keys, sketches = np.zeros((len(some), bands), np.uint64), np.zeros((len(some), _SKETCH // 32), np.uint64)
    if len(some):
        for j, (mask, factor) in enumerate(seeds):
            least = np.minimum.reduceat((hashes ^ mask) * (factor | np.uint64(1)), first[some])
            if j < _SKETCH:
                sketches[:, j // 32] |= ((least * _MIX) >> np.uint64(62)) << np.uint64(2 * (j % 32))
            if j < bands * rows:
                at = keys[:, j // rows]
                at ^= least + np.uint64(j // rows)
                at *= _MIX
                at ^= at >> np.uint64(29)
    return keys, sketches, some


def _features(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, digest, same, same2, weight, size, fingerprint, bands, sketch) of ``docs(id, digest, text)``.

    ``same`` and ``same2`` are two hashes of the words of the text, ``weight`` grows with
    their number; ``size`` is the number of distinct shingles, the fingerprint is that of the distinct shingles.  Texts without words
    have no band keys and no sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, "text"):
                words = Words(texts, NONSPACE)
                bytes_ = np.append(words.start, words.start[-1] + words.size[-1] + 1 if len(words.start) else 0)[words.first]
                same = [xxh64(words.norm, bytes_[:-1], np.diff(bytes_), seed) for seed in (1, 2)]
                start, size, first = words.shingles(shingle)
                hashes, first = _distinct(xxh64(words.norm, start, size), first)
                keys, sketches, some = _minima(hashes, first, bands, rows)
                ends = np.zeros(len(texts) + 1, np.int32)
                ends[some + 1] = 1
                ends = np.cumsum(ends, dtype=np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends * np.int32(x.shape[1])), pa.array(x.view(np.int64).ravel())) for x in (keys, sketches)]
                weight = pa.array((1 + np.diff(words.first) // 512).astype(np.int64))
                numbers = [pa.array(x.view(np.int64)) for x in same]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), *numbers, weight, pa.array(np.diff(first).astype(np.int64)), pa.array(simhash(hashes, first).view(np.int64)), *lists], ["id", "digest", "same", "same2", "weight", "size", "fingerprint", "bands", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "digest", "text").mapInArrow(run, f"id {kind}, digest binary, same long, same2 long, weight long, size long, fingerprint long, bands array<long>, sketch array<long>")


def _agreement(a: Column, b: Column) -> Column:
    """In how many places two sketches agree."""
    out = F.lit(_SKETCH)
    for i in range(_SKETCH // 32):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        out = out - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_PAIRS)))
    return out


class _Sets:
    """The sets of distinct shingles of texts."""

    def __init__(self, texts: list[bytes], shingle: int, similarity: float):
        words = Words(texts, NONSPACE)
        start, size, first = words.shingles(shingle)
        hashes, self.first = _distinct(xxh64(words.norm, start, size), first)
        self.n, self.similarity = np.diff(self.first), similarity
        known, self.places = np.unique(hashes, return_inverse=True)
        self.mark = np.zeros(len(known), bool)

    def like(self, a: int, others: np.ndarray) -> np.ndarray:
        """Whether each of ``others``, none of which is empty, is as similar to ``a`` as is asked."""
        own = self.places[self.first[a] : self.first[a + 1]]
        self.mark[own] = True
        n = self.n[others]
        ends = np.cumsum(n)
        inside = self.mark[self.places[np.arange(ends[-1]) + np.repeat(self.first[others] - ends + n, n)]]
        self.mark[own] = False
        shared = np.add.reduceat(inside.astype(np.int64), ends - n)
        return shared >= self.similarity * (self.n[a] + n - shared) - 1e-9


def _edges(table: pa.Table, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([table["node"].take(pa.array(x)).combine_chunks() for x in at.T], ["a", "b"])


def _starred(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, slab: int) -> DataFrame:
    """The pairs (a, b) that are similar.  A text is sent once for each ``a`` that it is held against, an ``a`` once a slab."""
    sizes = pairs.groupBy(F.col("a").alias("key")).agg(F.ceil(F.sum("weight") / slab).cast("int").alias("slabs"))
    ends = pairs.select(F.col("a").alias("key"), F.col("b").alias("node")).join(sizes, "key")
    ends = ends.select("key", F.pmod(F.xxhash64("node"), "slabs").cast("int").alias("s"), "node")
    heads = sizes.select("key", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("s"), F.col("key").alias("node"))
    rows = ends.union(heads).join(texts.select("node", "text"), "node").select("key", "s", F.col("s").alias("t"), "node", "text")

    def compare(table: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets = _Sets(payloads(table["text"]), shingle, similarity)
        head = table["node"].to_numpy() == table["key"].to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(run))
        found: list[tuple[int, int]] = []
        for low, high in zip(cuts, cuts[1:]):
            rows = np.arange(low, high)
            others = rows[~head[low:high]]
            if len(others) and len(others) < len(rows):
                a = int(rows[head[low:high]][0])
                found += [(a, b) for b in others[sets.like(a, others)].tolist()]
        yield _edges(table, found)

    return _grouped(rows).mapInArrow(lambda batches: _runs(batches, compare), "a long, b long")


def _grouped(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", *order)


def _candidates(table: pa.Table, run: np.ndarray, radius: int, agree: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, agreement, root of each row): pairs of one group within ``radius``, of different roots, whose sketches agree in ``agree`` places.

    Only rows from outside ask, which come first in a group: every pair of different roots
    has an end that is not of the root that most of a key's rows have.  A pair is given in
    the first band that it shares, and there in one group of slabs.
    """
    prints = table["fingerprint"].to_numpy().view(np.uint64)
    root = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
    outside, key, mine, size, cap = (table[c].to_numpy() for c in ("outside", "key", "mine", "size", "cap"))
    one = table["s"].to_numpy() == table["t"].to_numpy()
    bands, sketches = (pa.compute.list_flatten(table[c].combine_chunks()).to_numpy().reshape(len(key), -1) for c in ("bands", "sketch"))
    sketches = sketches.view(np.uint64)
    for i, j in close_pairs(prints, run, radius, outside):
        asked = (root[i] != root[j]) & (one[i] | (mine[i] != mine[j])) & (size[j] <= cap[i]) & (size[i] <= cap[j])
        i, j = i[asked], j[asked]
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            x = sketches[a] ^ sketches[b]
            alike = _SKETCH - np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_PAIRS)).sum(1, dtype=np.int64)
            a, b, alike = a[alike >= agree], b[alike >= agree], alike[alike >= agree]
            here = bands[a, (bands[a] == bands[b]).argmax(1)] == key[a]
            yield a[here], b[here], alike[here], root


def _apart(rows: DataFrame) -> DataFrame:
    """The rows of every ``key`` whose rows have several ``root``."""
    ends = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return rows.join(ends.where("low < high").select("key"), "key")


def _own(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, own): how many shingles of a text are in no other of ``texts(node, text)``; none: no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch, "text"):
                words = Words(part, NONSPACE)
                start, size, first = words.shingles(shingle)
                hashes, first = _distinct(xxh64(words.norm, start, size), first)
                node = np.repeat(batch.column(0).slice(at, len(part)).to_numpy(), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(hashes.view(np.int64))], ["node", "hash"])

    hashes = texts.select("node", "text").mapInArrow(run, "node long, hash long")
    return hashes.groupBy("hash").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("own"))


def _able(open_: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``open_`` with ``size`` and ``cap``, without rows that nothing of their key can be similar to.

    What a text shares with another is at most what it shares with all others together.
    So only texts of up to ``cap`` shingles can be similar to it, and a text with enough
    shingles of its own has no partner, of however many its key holds.
    """
    asked = open_.select("node").distinct()
    own = _own(texts.join(asked, "node", "left_semi"), shingle)
    shared = F.col("size") - F.coalesce("own", F.lit(0))
    cap = F.floor(shared * ((1 + similarity) / similarity) + 1e-6) - F.col("size")
    caps = nodes.select("node", "size").join(asked, "node", "left_semi").join(own, "node", "left").select("node", "size", cap.alias("cap"))
    sized = open_.join(caps, "node")
    least = sized.groupBy("key").agg(F.min("size").alias("least"))
    return _apart(sized.join(least, "key").where("cap >= least").drop("least"))


def _outside_first(rows: DataFrame, cost: Column, slab: int) -> DataFrame:
    """The rows of every ``key`` in groups (key, s, t) in which each from ``outside`` meets every other of its key.

    Outside are those that have not the root that most of a key's rows have.  They are dealt over slabs of ``slab``
    by ``cost``, and so are the others, which go to the slabs from outside alone: where these are one slab, once.  A key
    of up to ``slab`` is one group.
    """
    per = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum(cost).alias("cost"))
    split = per.groupBy("key").agg(F.max(F.struct("n", "root", "cost")).alias("main"), F.sum("cost").alias("cost"), F.count("*").alias("several")).where("several > 1")
    inner, outer = F.ceil(F.col("main.cost") / slab).cast("int"), F.ceil((F.col("cost") - F.col("main.cost")) / slab).cast("int")
    split = split.select("key", F.col("main.root").alias("main"), F.when(F.col("cost") > slab, inner).otherwise(0).alias("inner"), outer.alias("outer"))
    at = F.xxhash64("node")
    mine = F.when(F.col("outside") | (F.col("inner") == 0), F.pmod(at, "outer")).otherwise(F.col("outer") + F.pmod(at, "inner")).cast("int")
    last = F.col("outer") - 1 + F.when(F.col("outside"), F.col("inner")).otherwise(0)
    dealt = rows.join(split, "key").withColumn("outside", F.col("root") != F.col("main")).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select(*rows.columns, "outside", "mine", F.least("mine", "other").alias("s"), F.greatest("mine", "other").alias("t"))


def _across(met: DataFrame, nodes: DataFrame, texts: DataFrame, roots: DataFrame, radius: int, agree: int, shingle: int, similarity: float, slab: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between nodes of one key of ``met(key, node, weight)`` and of different ``roots``, a forest in each group.

    Keys whose nodes have one root are done, and so are nodes that share too few shingles
    (see :func:`_able`).  Of the others, groups of slabs, of ``16 * slab`` rows without texts,
    first tell which have a candidate at all; only these have their texts sent.  No pair
    leaves a group but a link that the group has not made before.
    """
    rooted = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = scratch.save(_apart(rooted))
    able = scratch.save(_able(open_, nodes, texts, shingle, similarity))
    scratch.drop(open_)
    columns, kinds = able.columns, able.schema

    def ask(table: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(len(run), bool)
        for i, j, _, _ in _candidates(table, run, radius, agree):
            wanted[i] = wanted[j] = True
        yield from table.select(columns).filter(pa.array(wanted)).combine_chunks().to_batches()

    def decide(table: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets = _Sets(payloads(table["text"]), shingle, similarity)
        up, found = np.arange(len(run)), []

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = int(up[x])
            return x

        for i, j, alike, root in _candidates(table, run, radius, agree):
            order = np.lexsort((-alike, i))
            i, j = i[order], j[order]
            cuts = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i))
            for low, high in zip(cuts, cuts[1:]):
                a, others, step = int(i[low]), j[low:high], 4
                while len(others):  # the most alike first: a link makes the others of that root needless
                    part, others = others[:step], others[step:]
                    for b in part[sets.like(a, part)].tolist():
                        one, two = find(int(root[a])), find(int(root[b]))
                        if one != two:
                            up[one] = two
                            found.append((a, b))
                    own, step = find(int(root[a])), 4 * step
                    others = others[[find(x) != own for x in root[others].tolist()]] if len(others) else others
        yield _edges(table, found)

    features = nodes.select("node", "fingerprint", "bands", "sketch")
    asked = _grouped(_outside_first(able, F.lit(1), 16 * slab).join(features, "node"), F.desc("outside"))
    wanted = scratch.save(asked.mapInArrow(lambda batches: _runs(batches, ask), kinds).dropDuplicates(["key", "node"]))
    scratch.drop(able)
    rows = _outside_first(wanted, F.col("weight"), slab).join(features, "node").join(texts, "node")
    return _grouped(rows, F.desc("outside")).mapInArrow(lambda batches: _runs(batches, decide), "a long, b long")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 23, bands: int = 20, rows: int = 5, slab: int = 256) -> DataFrame:
    """(id, digest, least, least_digest) for every distinct id and text: the smallest of its group of near-duplicates.

    Texts are linked if the Jaccard similarity of their sets of ``shingle``-word shingles is
    ``similarity`` or more; groups are what links connect.  Blocks of one fingerprint cannot
    find these pairs (at 0.8 about 10 of 64 bits differ), so texts meet under ``bands`` keys,
    each of ``rows`` least shingle hashes: a pair at 0.8 misses all 20 with a probability of
    0.0004.  Fingerprints, compared bit-sliced, then drop pairs over ``radius`` bits (4.5
    deviations above the mean at 0.8), sketches of 256 least hashes those that agree in 4.5
    deviations fewer places than is expected at ``similarity``, and the whole texts decide.

    First each text is held against the two likest of the first texts of its keys, a number
    of pairs linear in the texts.  Keys that are then not in one group have their texts
    compared in slabs, all that are still apart and share enough shingles.  Equal texts fall together first; an id
    with several texts stands in the group of each.  Texts without words are equal to
    each other.  Null ids are left out.  ``digest`` is the MD5 of the text.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    found = scratch.save(_features(named, shingle, bands, rows))
    least = F.struct("id", "digest")
    classes = found.groupBy("same", "same2").agg(F.min(least).alias("least"), *(F.first(c).alias(c) for c in ("weight", "size", "fingerprint", "bands", "sketch")))
    nodes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()))  # written, so they stay
    found, every = scratch.save(found.select("id", "digest", "same", "same2")), found
    scratch.drop(every)

    keyed = nodes.select("node", "weight", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    met = scratch.save(keyed.join(heads, "key"))
    own = met.select("node").distinct().join(nodes.select("node", "least.*"), "node")
    once = named.groupBy("id", "digest").agg(F.first("text").alias("text"))  # repeated rows are met before the shuffle
    texts = scratch.save(once.join(own, ["id", "digest"]).select("node", "text"))

    mean = similarity + (1 - similarity) / 4
    agree = math.floor(_SKETCH * mean - 4.5 * math.sqrt(_SKETCH * mean * (1 - mean)))
    pairs = met.where("a < node").select("a", F.col("node").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("fingerprint", "sketch", "weight"))), end)
    near = F.bit_count(F.col("fingerprint_a").bitwiseXOR(F.col("fingerprint_b"))) <= radius
    pairs = pairs.where(near).select("a", "b", F.col("weight_b").alias("weight"), _agreement(F.col("sketch_a"), F.col("sketch_b")).alias("alike")).where(F.col("alike") >= agree)
    likest = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("alike"), "a"))  # of as many as there are bands at most
    pairs = scratch.save(pairs.withColumn("k", likest).where("k <= 2").select("a", "b", "weight"))
    edges = scratch.save(_starred(pairs, texts, shingle, similarity, max(1, slab // 4)))
    scratch.drop(pairs)
    roots = components(edges, scratch)
    more = scratch.save(_across(met.select("key", "node", "weight"), nodes, texts, roots, radius, agree, shingle, similarity, slab, scratch))
    for done in (met, texts):
        scratch.drop(done)
    roots = components(edges.union(more), scratch)

    grouped = nodes.select("node", "same", "same2", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = grouped.groupBy("root").agg(F.min("least").alias("least"))
    groups = grouped.drop("least").join(firsts, "root").select("same", "same2", F.col("least.id").alias("least"), F.col("least.digest").alias("least_digest"))
    return found.join(groups, ["same", "same2"]).groupBy("id", "digest").agg(F.first("least").alias("least"), F.first("least_digest").alias("least_digest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs``, all columns, with one document of each group of :func:`similar_groups` (``how``): the one with the smallest id.

    An id and a text name a document: of repeated rows with both one stays, and an id with
    several texts keeps each that is the first of its group.  Rows with a null id cannot be
    told apart by id and are kept as they are.  An empty table gives no rows.
    """
    stays = similar_groups(docs, id_col, text_col, **how).where("id = least and digest = least_digest").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    named = docs.where(F.col(id_col).isNotNull()).withColumns({"_id": F.col(id_col), "_digest": _digest(F.col(text_col))})
    return named.join(stays, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]).select(docs.columns).union(docs.where(F.col(id_col).isNull()))
