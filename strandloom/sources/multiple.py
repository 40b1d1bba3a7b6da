"""Alignments as text: MAF blocks and axtNet pairs, cut where a row has a gap.

A file is split at blocks, and a block is one row of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = re.compile("[^-]+")


def read_maf(spark: SparkSession, path: str, known: DataFrame | None = None, header: bool = True) -> DataFrame:
    """(block, seq_id, start, stop, col_start, col_stop): each gap-free run of each ``s`` line.

    ``block`` is the block's text hash, columns count from the block's first; a minus row's
    coordinates are negative.  ``header``: a path of which no file begins with ``##maf`` is
    a ``ValueError``, at once.  ``known(seq_id)``: rows of other sequences are left out.
    """
    if header and not spark.read.text(path).where(F.col("value").startswith("##maf")).limit(1).count():
        raise ValueError(f"no ##maf line in {path}")
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").rlike(r"(?m)^a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                block = int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)
                for line in text.splitlines():
                    f = line.split()
                    if len(f) == 7 and f[0] == "s":
                        at, total, gaps = int(f[2]), int(f[5]), 0
                        at, last = (-(total - at) if f[4] == "-" else at), 0
                        for m in _RUN.finditer(f[6]):
                            gaps += m.start() - last
                            last = m.end()
                            out.append((block, f[1], at + m.start() - gaps, at + m.end() - gaps, m.start(), m.end()))
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in out], schema)

    names = ["block", "seq_id", "start", "stop", "col_start", "col_stop"]
    schema = pa.schema([(n, pa.string() if n == "seq_id" else pa.int64()) for n in names])
    found = blocks.mapInArrow(run, "block long, seq_id string, start long, stop long, col_start long, col_stop long")
    return found if known is None else found.join(known.select("seq_id").distinct(), "seq_id", "left_semi").select(names)


def pairs(runs: DataFrame, source: str) -> DataFrame:
    """(src, start, stop, tgt, tgt_start, tgt_stop): runs of a block, those of ids that begin with ``source`` against all others, where their columns overlap."""
    a, b = runs.where(F.col("seq_id").startswith(source)), runs.where(~F.col("seq_id").startswith(source))
    a, b = (x.select("block", *[F.col(c).alias(f"{n}{c}") for c in ("seq_id", "start", "col_start", "col_stop")]) for x, n in ((a, "a_"), (b, "b_")))
    both = a.join(b, "block").where("a_col_start < b_col_stop and b_col_start < a_col_stop")
    low, high = F.greatest("a_col_start", "b_col_start"), F.least("a_col_stop", "b_col_stop")
    place = lambda n, at: F.col(f"{n}start") + at - F.col(f"{n}col_start")
    return both.select(F.col("a_seq_id").alias("src"), place("a_", low).alias("start"), place("a_", high).alias("stop"), F.col("b_seq_id").alias("tgt"), place("b_", low).alias("tgt_start"), place("b_", high).alias("tgt_stop"))


def read_axt(spark: SparkSession, path: str, lengths: DataFrame, source: str = "", target: str = "") -> DataFrame:
    """(src, start, stop, tgt, tgt_start, tgt_stop) of pairwise blocks: a summary line and a line of letters for either side.

    Places in the text count from 1; a target on the reverse strand is given from that
    strand's begin, for which ``lengths(seq_id, length)`` is needed.  ``source`` and
    ``target`` are put before the names.  Blocks of unknown sequences are left out.
    """
    records = spark.read.option("lineSep", "\n\n").text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                lines = [x for x in text.splitlines() if x and not x.startswith("#")]
                f = lines[0].split() if len(lines) >= 3 else []
                if len(f) != 9 or not f[0].isdigit():
                    continue
                a, b, at = int(f[2]) - 1, int(f[5]) - 1, None
                for x, y in zip(lines[1] + "-", lines[2] + "-"):
                    if x == "-" or y == "-":
                        if at:
                            out.append((source + f[1], at[0], a, target + f[4], at[1], b, f[7] == "-"))
                        at = None
                    elif not at:
                        at = a, b
                    a, b = a + (x != "-"), b + (y != "-")
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in out], schema)

    kinds = {"src": pa.string(), "tgt": pa.string(), "minus": pa.bool_()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in ("src", "start", "stop", "tgt", "tgt_start", "tgt_stop", "minus")])
    found = records.mapInArrow(run, "src string, start long, stop long, tgt string, tgt_start long, tgt_stop long, minus boolean")
    known = lengths.select(F.col("seq_id").alias("tgt"), "length")
    found = found.join(lengths.select(F.col("seq_id").alias("src")), "src", "left_semi").join(known, "tgt")
    back = F.when(F.col("minus"), F.col("length")).otherwise(0)
    return found.select("src", "start", "stop", "tgt", (F.col("tgt_start") - back).alias("tgt_start"), (F.col("tgt_stop") - back).alias("tgt_stop"))


def save_relational(runs: DataFrame, path: str) -> None:
    """Runs of :func:`read_maf` as two tables: ``blocks``, one row for each block as a sequence of its own, and ``runs`` against it."""
    runs.groupBy("block").agg(F.max("col_stop").alias("length"), F.countDistinct("seq_id").alias("rows")).write.parquet(f"{path}/blocks")
    runs.select(F.col("block").alias("src"), F.col("col_start").alias("start"), F.col("col_stop").alias("stop"), F.col("seq_id").alias("tgt"), F.col("start").alias("tgt_start"), F.col("stop").alias("tgt_stop")).write.parquet(f"{path}/runs")
