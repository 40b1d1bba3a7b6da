"""Token ids in training order: fixed-stride binary shards.

Texts are encoded by byte-level BPE, here by the tiktoken library, whose ids the encoder of
:mod:`strandloom.llm.bpe` equals at several times the cost; texts that it cannot match go
to that encoder.  An id after the vocabulary's last ends a document and
one more fills the last sequence of a partition.  A partition's documents are one stream,
cut into sequences of equal length, which are kept in a table, numbered within the
partition.  When all are there, their number is known; they are numbered densely,
partition by partition, and a keyed Feistel permutation of the next power of four, walked
until it falls within their number, gives each its slot in training order.  Slot ``s`` is
row ``s % rows`` of shard ``s // rows``, so a reader seeks to any slot and reads on from there.

Sequences go through one shuffle, compressed, to partitions that are ranges of shards.  A
shard is written under another name and then moved, and its bytes depend on the kept table
and the key alone, so a task that is run again replaces it with the same.  The manifest is
written last: where there is one, all shards are.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.llm.bpe import codec, read_ranks
from strandloom.llm.common import Scratch
from strandloom.llm.textkernel import slices

_FLUSH = 4 << 20  # tokens that are held before whole sequences are handed on
_ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 to ``n - 1``, chosen by ``key``: the slot of each sequence number."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = _mix(np.uint64(key & (2**64 - 1)) + np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


_encodings: dict[str, tiktoken.Encoding] = {}


def _encoding(raw: bytes, pattern: str) -> tiktoken.Encoding:
    """One encoder a worker process for each vocabulary."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=read_ranks(raw), special_tokens={})
    return _encodings[key]


def _cut(batches: Iterator[tuple[list, list[np.ndarray]]], length: int, pad: int, kind: str) -> Iterator[tuple[np.ndarray, list[list]]]:
    """Blocks of whole sequences of a partition's stream of (ids, tokens), with the ids of the documents in each."""
    held, ids, ends, size = [], [], [], 0

    def cut(last: bool) -> tuple[np.ndarray, list[list]]:
        nonlocal held, ids, ends, size
        data = np.concatenate(held)
        n = -(-size // length) if last else size // length
        rows = np.full(n * length, pad, kind)
        rows[: min(size, n * length)] = data[: n * length]
        stop = np.array(ends)
        start = np.concatenate(([0], stop[:-1]))
        low, high = start // length, np.minimum((stop - 1) // length, n - 1)
        within: list[list] = [[] for _ in range(n)]
        for i, a, b in zip(ids, low.tolist(), high.tolist()):
            for s in range(a, b + 1):
                within[s].append(i)
        rest = data[n * length :]
        over = stop > n * length
        held, size = [rest] if len(rest) else [], len(rest)
        ids, ends = [i for i, o in zip(ids, over) if o], (stop[over] - n * length).tolist()
        return rows.reshape(n, length), within

    for names, texts in batches:
        for i, tokens in zip(names, texts):
            held.append(tokens)
            size += len(tokens)
            ids.append(i)
            ends.append(size)
        if size >= _FLUSH:
            yield cut(False)
    if size:
        yield cut(True)


def write(docs: DataFrame, folder: str, key: int, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, rows: int = 8192) -> DataFrame:
    """Writes the shards and a manifest to ``folder``, which executors must share; returns (slot, shard, row, n_tokens, ids, sha256).

    One result row for each sequence, made from the shard's bytes as read back; ``ids``
    are those of the documents in it.  ``vocabulary`` is the path of a rank file on the
    driver.  Tokens are little-endian, of 16 bits where the vocabulary leaves two ids of
    them free and of 32 otherwise.  Null texts are empty documents, null ids are carried
    along, repeated rows are all written; an empty table gives no shard.  When this
    returns, all is written.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        raw = f.read()
    eos = max(read_ranks(raw).values(), default=-1) + 1
    pad, dtype = eos + 1, "<u2" if eos + 1 < 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(raw)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    batch_type = to_arrow_type(docs.schema[id_col].dataType)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, first, pack = _encoding(shared.value, pattern), TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=7)

        def encode(text: str) -> np.ndarray:
            try:
                return own.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # the library's pattern matching gives up, as at very much white space; the ids are the same
                return np.frombuffer(codec(shared.value, pattern).encode(text), "<u4")

        def encoded() -> Iterator[tuple[list, list[np.ndarray]]]:
            for batch in batches:
                for at, texts in slices(batch, "text"):
                    tokens = [np.append(encode(t.decode()), eos).astype(dtype) for t in texts]
                    yield batch.column(0).slice(at, len(texts)).to_pylist(), tokens

        for block, within in _cut(encoded(), length, pad, dtype):
            for i in range(0, len(block), 512):
                rows_, ids = block[i : i + 512], within[i : i + 512]
                data = [pa.array([part], pa.int32()), pa.array([first]), pa.array([ids], pa.list_(pa.list_(batch_type))), pa.array([pack.compress(rows_.tobytes())], pa.binary())]
                yield pa.RecordBatch.from_arrays(data, ["part", "first", "ids", "data"])
                first += len(rows_)

    scratch = Scratch(spark, "shards")
    kept = scratch.save(source.mapInArrow(keep, f"part int, first long, ids array<array<{kind}>>, data binary"))
    begin, n = {}, 0
    for part, count in sorted((r.part, r.n) for r in kept.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect()):  # a row for each partition
        begin[part], n = n, n + count
    starts = spark.sparkContext.broadcast(begin)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=7)
        for batch in batches:
            for part, first, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                block = np.frombuffer(zstandard.decompress(data), dtype).reshape(-1, length)
                slot = slots(starts.value[part] + first + np.arange(len(block)), n, key)
                shard = slot // rows
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
                groups = np.split(order, cuts[1:])
                columns = [pa.array(shard[order[cuts]]), pa.array([slot[g] for g in groups], pa.list_(pa.int64())), pa.array([[ids[i] for i in g] for g in groups], pa.list_(pa.list_(batch_type))), pa.array([pack.compress(block[g].tobytes()) for g in groups], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "slots", "ids", "data"])

    shards = -(-n // rows)
    width = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), max(shards, 1))
    placed = kept.mapInArrow(place, f"shard long, slots array<long>, ids array<array<{kind}>>, data binary")
    dealt = placed.repartitionById(width, F.expr(f"cast(shard * {width} div {max(shards, 1)} as int)")).sortWithinPartitions("shard")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        now, held, names = None, None, []
        for batch in batches:
            for shard, slot, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if now is not None:
                        yield _finish(files, root, now, held, names, rows, pad, batch_type)
                    count = min(rows, n - shard * rows)
                    now, held, names = shard, np.full((count, length), pad, dtype), [[] for _ in range(count)]
                at = np.array(slot) - shard * rows
                held[at] = np.frombuffer(zstandard.decompress(data), dtype).reshape(-1, length)
                for r, i in zip(at.tolist(), ids):
                    names[r] = i
        if now is not None:
            yield _finish(files, root, now, held, names, rows, pad, batch_type)

    index = scratch.save(dealt.mapInArrow(save, f"slot long, shard int, row int, n_tokens int, ids array<{kind}>, sha256 string"))
    scratch.drop(kept)
    about = json.dumps({"sequences": n, "length": length, "rows": rows, "key": key, "eos": eos, "pad": pad, "dtype": dtype})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/manifest")
    return index


def _name(root: str, shard: int) -> str:
    return posixpath.join(root, f"shard-{shard:08d}.bin")


def _finish(files: fs.FileSystem, root: str, shard: int, held: np.ndarray, names: list, rows: int, pad: int, kind: pa.DataType) -> pa.RecordBatch:
    path = _name(root, shard)
    aside = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(aside) as f:
        f.write(held.tobytes())
    files.move(aside, path)
    with files.open_input_stream(path) as f:
        back = np.frombuffer(f.read(), held.dtype).reshape(held.shape)
    digests = [hashlib.sha256(r.tobytes()).hexdigest() for r in back]
    row = np.arange(len(back), dtype=np.int32)
    arrays = [pa.array(row.astype(np.int64) + shard * rows), pa.array(np.full(len(row), shard, np.int32)), pa.array(row), pa.array((back != pad).sum(1).astype(np.int32)), pa.array(names, pa.list_(kind)), pa.array(digests)]
    return pa.RecordBatch.from_arrays(arrays, ["slot", "shard", "row", "n_tokens", "ids", "sha256"])


def manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder.rstrip('/')}/manifest").first()[0])


def read(folder: str, about: dict, first: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, tokens without padding) from slot ``first`` on, in order; a reader that stopped resumes at its next slot."""
    files, root = fs.FileSystem.from_uri(folder)
    kind, rows = np.dtype(about["dtype"]), about["rows"]
    stride = about["length"] * kind.itemsize
    last = about["sequences"] if count is None else min(about["sequences"], first + count)
    while first < last:
        shard, row = divmod(first, rows)
        with files.open_input_file(_name(root, shard)) as f:
            f.seek(row * stride)
            for first in range(first, min(last, (shard + 1) * rows)):
                tokens = np.frombuffer(f.read(stride), kind)
                yield first, tokens[tokens != about["pad"]]
        first += 1
