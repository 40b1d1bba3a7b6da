"""Cross-entropy difference between two matched n-gram models.

Target and background are bigram models over one vocabulary, every word of all documents.
A bigram's rate is its count, interpolated with the rate of the word by ``strength``
observations (Dirichlet), and a word's rate its count with one observation more for each
word of the vocabulary.  The background is made of all documents; its counts are scaled to
the target's number of words, so that both are smoothed alike.  A document is scored by
what the others tell: its own counts are taken out of both models first, so a passage that
it repeats from elsewhere costs it less than one that only it has.

Each token's loss under the background is taken from its loss under the target; a
document's score is the mean, and below 0 the document is more like the target.

All words and pairs of words of all documents are counted, as 55-bit hashes.  Texts are
packed into blocks.  A block sends its distinct words and pairs, with how often it has
them, to the parts of the hash space that they fall into, sorted and compressed; a part
adds up what the blocks have and sends back to each the counts that differ from its own.
So a word or pair is sent once a block however common it is, no part has more than about
``_PART`` of them, and nothing is gathered or broadcast but the totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch
from strandloom.llm.textkernel import ALNUM, Words, slices, xxh64

_BLOCK_BYTES = 4 << 20
_PART = 1 << 20  # keys that a part of the hash space has, about
_KEY_BITS = 56  # 55 bits of hash above one that tells pairs from words
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays of integers, byte by byte from the lowest on, compressed."""
    planes = [np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, k: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(k, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


class _Block:
    """A block's distinct words and pairs as sorted ``keys``, and the place there of each token's.

    The beginning of a document is a word (key 0) that comes before its first; as what
    follows the last word it is counted once, too.
    """

    def __init__(self, texts: list[bytes]):
        words = Words(texts, ALNUM)
        hashes = xxh64(words.norm, words.start, words.size, 0)
        first = words.first
        self.n = np.diff(first)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        some = self.n > 0
        before = np.concatenate((np.zeros(1, np.uint64), hashes[:-1])) if len(hashes) else hashes
        before[first[:-1][some]] = 0
        pair = ((before ^ before >> np.uint64(29)) * _MIX) ^ hashes
        pair = (pair ^ pair >> np.uint64(32)) * _MIX2
        nine, one = np.uint64(9), np.uint64(1)
        every = np.concatenate((np.zeros(int(some.sum()), np.uint64), hashes >> nine << one, pair >> nine << one | one))
        self.keys, place = np.unique(every, return_inverse=True)
        begins = int(some.sum())
        self.begin, self.word, self.pair = place[:begins], place[begins : begins + len(hashes)], place[begins + len(hashes) :]
        self.some, self.starts = np.flatnonzero(some), first[:-1][some]

    def counts(self, docs: np.ndarray | None = None) -> np.ndarray:
        """How often the block has each key; with ``docs``, a mask, how often those have."""
        parts = (self.begin, self.word, self.pair)
        if docs is not None:
            parts = (self.begin[docs[self.some]], self.word[docs[self.doc]], self.pair[docs[self.doc]])
        return sum(np.bincount(p, minlength=len(self.keys)) for p in parts)

    def own(self, place: np.ndarray) -> np.ndarray:
        """For each token, how often its document has its key."""
        _, at, n = np.unique(self.doc * max(len(self.keys), 1) + place, return_inverse=True, return_counts=True)
        return n[at]

    def before(self, of_word: np.ndarray, of_begin: np.ndarray) -> np.ndarray:
        """For each token, what the word before it has."""
        out = np.concatenate((of_word[:1], of_word[:-1]))
        out[self.starts] = of_begin
        return out


def _packed(docs: DataFrame) -> DataFrame:
    """(block, n, ids, sizes, data): the texts of ``docs(id, text)``, compressed, a row for each slice; ``n`` is its bytes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at, texts in slices(batch, "text", _BLOCK_BYTES):
                ids, data = batch.column(0).slice(at, len(texts)), b"".join(texts)
                sizes = np.array([len(t) for t in texts], "<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(data)]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sizes], pa.binary()), pa.array([pack.compress(data)], pa.binary())], ["block", "n", "ids", "sizes", "data"])
                block += 1

    return docs.select("id", "text").mapInArrow(run, f"block long, n long, ids array<{kind}>, sizes binary, data binary")


def _texts(sizes: bytes, data: bytes) -> list[bytes]:
    data, ends = zstandard.decompress(data), np.cumsum(np.frombuffer(sizes, "<i4"))
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _asked(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, base, data): what each block has of a part; ``base`` is the place of its first key.

    ``blocks`` has the places of the target's documents as ``aims``.
    """
    width = (1 << _KEY_BITS) // parts + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, aims, sizes, data = (batch.column(c)[row].as_py() for c in range(4))
                x, docs = _Block(_texts(sizes, data)), np.zeros(len(sizes) // 4, bool)
                docs[aims or []] = True
                all_, aim = x.counts(), x.counts(docs)
                part = (x.keys // np.uint64(width)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                for i in range(0, len(cuts) - 1, 1024):
                    here = [(a, b) for a, b in zip(cuts[i : i + 1024], cuts[i + 1 : i + 1025])]
                    packed = [_pack(np.diff(x.keys[a:b], prepend=np.uint64(0)), all_[a:b], aim[a:b]) for a, b in here]
                    base = np.array([a for a, _ in here])
                    yield pa.RecordBatch.from_arrays([pa.array(part[base]), pa.array(np.full(len(here), number)), pa.array(base), pa.array(packed, pa.binary())], ["part", "block", "base", "data"])

    return blocks.select("block", "aims", "sizes", "data").mapInArrow(run, "part long, block long, base long, data binary")


def _told(asked: DataFrame) -> DataFrame:
    """(block, data, words, all, aim): the counts that differ from a block's own and, where ``block`` is null, a part's totals of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            blocks, bases, data = zip(*held)
            rows = [_unpack(d, 3) for d in data]
            keys = np.concatenate([np.cumsum(r[0], dtype=np.uint64) for r in rows])
            counts = [np.concatenate([r[k] for r in rows]).astype(np.int64) for k in (1, 2)]
            known, place = np.unique(keys, return_inverse=True)
            sums = [np.bincount(place, c, len(known)).astype(np.int64) for c in counts]
            words = known & np.uint64(1) == 0
            total = [int(words.sum()), *(int(s[words].sum()) for s in sums)]
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), *(pa.array([t]) for t in total)], names)
            out, low = [], 0
            for base, row in zip(bases, rows):
                here = slice(low, low + len(row[0]))
                low += len(row[0])
                every = [s[place[here]] for s in sums]
                at = np.flatnonzero((every[0] != counts[0][here]) | (every[1] != counts[1][here]))
                out.append(_pack(np.diff(at + base, prepend=0), *(e[at] for e in every)) if len(at) else None)
            none = pa.nulls(len(out), pa.int64())
            told = pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(out, pa.binary()), none, none, none], names)
            yield told.filter(told.column(1).is_valid())

        names = ["block", "data", "words", "all", "aim"]
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and held:
                    yield from done()
                    held = []
                now = part
                held.append(row)
        if held:
            yield from done()

    dealt = asked.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "block long, data binary, words long, all long, aim long")


def _scored(blocks: DataFrame, words: int, all_: int, aim: int, strength: float) -> DataFrame:
    """The scores of the documents of ``blocks(ids, aims, sizes, data, told)``, given the totals of words."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    scale = (1.0, aim / all_ if all_ and aim else 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                aims, sizes, data, told = (batch.column(c)[row].as_py() for c in range(1, 5))
                x, docs = _Block(_texts(sizes, data)), np.zeros(len(sizes) // 4, bool)
                docs[aims or []] = True
                counts = [x.counts(docs), x.counts()]
                for d in told or []:
                    at, *every = _unpack(d, 3)
                    at = np.cumsum(at.astype(np.int64))
                    counts[1][at], counts[0][at] = every
                own_word, own_pair = x.own(x.word), x.own(x.pair)
                means = []
                for k, (count, whole) in enumerate(zip(counts, (aim, all_))):
                    mine = docs[x.doc] if k == 0 else np.ones(len(x.doc), bool)
                    word, pair = (scale[k] * (count[p] - o * mine) for p, o in ((x.word, own_word), (x.pair, own_pair)))
                    begin = scale[k] * (count[x.begin] - (docs[x.some] if k == 0 else 1))
                    total = scale[k] * (whole - ((x.n + 1) * (docs if k == 0 else 1))[x.doc])
                    rate = (word + 1) / (total + words)
                    loss = -np.log((pair + strength * rate) / (x.before(word, begin) + strength))
                    means.append(np.bincount(x.doc, loss, len(x.n)) / np.maximum(x.n, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, pa.array(x.n.astype(np.int64)), *map(pa.array, means), pa.array(means[0] - means[1])], ["id", "n_tokens", "target_loss", "background_loss", "score"])

    return blocks.select("ids", "aims", "sizes", "data", "told").mapInArrow(run, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", strength: float = 8.0) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) for every row; losses are means per token, in nats.

    ``target(id)``: ids whose documents the target model is made of (null and repeated ids
    do no harm); the background is all documents.  Words are runs of ASCII letters and
    digits and of anything beyond ASCII, A-Z lower-cased.  A text without words has losses
    and a score of 0; null ids are carried along and belong to the background; repeated
    rows are all counted and returned, and each is scored without its own counts only.
    Without a target, both models know nothing of it but the vocabulary.  An empty table
    gives no rows.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = scratch.save(_packed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    chosen = target.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    # Only ids meet the target, and a block then gets the places of those that do.
    aims = blocks.select("block", F.posexplode("ids").alias("pos", "id")).join(chosen, "id").groupBy("block").agg(F.collect_list("pos").alias("aims"))
    aims = scratch.save(aims)
    parts = 1 + (blocks.agg(F.sum("n")).first()[0] or 0) // (2 * _PART)  # a word and a pair in about four bytes
    told = scratch.save(_told(_asked(blocks.join(aims, "block", "left"), parts)))
    total = told.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "all", "aim"))).first()
    answers = told.where("block is not null").groupBy("block").agg(F.collect_list("data").alias("told"))
    both = blocks.join(aims, "block", "left").join(answers, "block", "left")
    return _scored(both, total["words"], total["all"], total["aim"], strength).withColumnRenamed("id", id_col)
