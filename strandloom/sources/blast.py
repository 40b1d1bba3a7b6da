"""Search reports as text: ungapped intervals of each alignment.

A file is split at queries; the report of one query is one row of text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "src_id string, src_start long, src_end long, src_ori int, dest_id string, dest_start long, dest_end long, dest_ori int, score double, e_value double, percent_id int, hit long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class _Side:
    """One side's letters and ends of an alignment."""

    def __init__(self):
        self.letters, self.start, self.end = "", 0, 0

    def add(self, start: int, letters: str, end: int) -> None:
        if not self.letters:
            self.start = start - 1 if start < end else start
        self.letters, self.end = self.letters + letters, end

    def direction(self) -> tuple[int, int]:
        """(strand, letters of the sequence to a letter shown): three where a protein stands for nucleotides."""
        shown = len(self.letters.replace("-", ""))
        return (1 if self.start < self.end else -1), 3 if abs(self.end - self.start) > 2 * shown else 1


def intervals(query: _Side, subject: _Side) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(start, end, strand) of the query and of the subject for each stretch without a gap on either side."""
    ways = query.direction(), subject.direction()
    done, begin = [0, 0], None
    for letters in zip(query.letters + "-", subject.letters + "-"):
        if "-" in letters:
            if begin:
                out = []
                for side, (way, unit), a, z in zip((query, subject), ways, begin, done):
                    ends = sorted((side.start + a * way * unit, side.start + z * way * unit))
                    out += [*ends, way]
                yield tuple(out)
            begin = None
        elif not begin:
            begin = tuple(done)
        done = [n + (c != "-") for n, c in zip(done, letters)]


def parse(text: str) -> Iterator[tuple]:
    """Rows of :data:`SCHEMA` of the report of one query, which begins with its name.

    A subject's letters that run into its number are parted where the query's begin, and a
    subject that is too short is filled with A; a query that is too short is an error.
    """
    source, target, hit = (text.split() or [""])[0], "", 0
    score = e_value = percent = None
    query, subject, column = _Side(), _Side(), 0

    def done() -> Iterator[tuple]:
        nonlocal query, subject, hit
        if query.letters and subject.letters:
            for a, b, way, c, d, other in intervals(query, subject):
                yield source, a, b, way, target, c, d, other, score, e_value, percent, hit
            hit += 1
        query, subject = _Side(), _Side()

    for line in text.splitlines()[1:]:
        if line.startswith((">", " Score =", "  Database:")):
            yield from done()
        if line.startswith(">"):
            target = line.split()[0][1:]
        elif line.startswith(" Score ="):
            f = line.split()
            score, e = float(f[2]), f[7].rstrip(",")
            e = float("1" + e if e.startswith("e") else e)
            e_value = -math.log10(e) if e > 0 else 300.0
        elif "Identities =" in line:
            percent = int(re.search(r"\((\d+)%", line)[1])
        elif line.startswith("Query:"):
            f = line.split()
            column = line.find(f[2], 5)
            query.add(int(f[1]), f[2], int(f[3]))
        elif line.startswith("Sbjct:"):
            f = line.split()
            if len(f) < 4:
                f = ["Sbjct:", line[6:column], *line[column:].split()]
            subject.add(int(f[1]), f[2], int(f[3]))
            short = len(query.letters) - len(subject.letters)
            if short < 0:
                raise ValueError(f"the query's line is shorter than the subject's: {query.letters} {subject.letters}")
            subject.letters += short * "A"
    yield from done()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The intervals of all reports of a file, as :data:`SCHEMA`; ``hit`` counts a query's alignments from 0.

    Ends are on the forward strand with the strand beside them; ``e_value`` is minus its
    decimal logarithm, 300 for zero.  An empty file is an ``OSError``, at once.
    """
    reports = spark.read.option("lineSep", "\nQuery=").text(path)
    if not reports.limit(1).count():
        raise OSError(f"no report in {path}")
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.removeprefix("Query=") for t in batch.column(0).to_pylist())
            rows = [row for t in texts if "Sbjct:" in t for row in parse(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, row)) for row in rows], schema)

    return reports.mapInArrow(run, SCHEMA)


def as_alignment(hits: DataFrame, *pipeline) -> DataFrame:
    """(src, start, stop, tgt, tgt_start, tgt_stop) of hits, signed by strand; each function of ``pipeline`` first gets the hits and returns those to keep."""
    for step in pipeline:
        hits = step(hits)
    out = []
    for side, names in (("src", ("src", "start", "stop")), ("dest", ("tgt", "tgt_start", "tgt_stop"))):
        a, b, back = F.col(f"{side}_start"), F.col(f"{side}_end"), F.col(f"{side}_ori") < 0
        out += [F.col(f"{side}_id").alias(names[0]), F.when(back, -b).otherwise(a).alias(names[1]), F.when(back, -a).otherwise(b).alias(names[2])]
    return hits.select(out)


def program(query_type: Column, database_type: Column) -> Column:
    """The search that goes with two alphabets (0 DNA, 1 RNA, 2 protein)."""
    query, database = query_type == 2, database_type == 2
    return F.when(query & database, "blastp").when(query, "tblastn").when(database, "blastx").otherwise("blastn")


# fixed value: letters to a piece of a sequence
_PIECE = 64


def seeds(queries: DataFrame, targets: DataFrame, k: int = 12, most: int = 1000, masked: bool = False) -> DataFrame:
    """(src, start, stop, tgt, tgt_start, tgt_stop): the longest stretches in which ``queries(seq_id, seq)`` and ``targets`` have the same ``k`` letters after each other.

    A search without gaps and on one strand, in place of an external program.  Words that
    the targets have more than ``most`` times are repeats and start no stretch.  With
    ``masked`` so are words with a lower-case letter in the query, as
    :func:`strandloom.functions.sequences.soft_masked` leaves them; case does not count else.
    """

    def words(seqs: DataFrame, name: str) -> DataFrame:
        """By pieces: a letter's place is found from the beginning, so that of a word would cost as much as the sequence is long."""
        rows = seqs.where(F.length("seq") >= k).select(F.col("seq_id").alias(name), F.col("seq"), F.explode(F.expr(f"sequence(1, length(seq) - {k - 1}, {_PIECE})")).alias("p"))
        rows = rows.select(name, "p", F.expr(f"substring(seq, p, {_PIECE + k - 1})").alias("piece"))
        rows = rows.select(name, "p", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - (k - 1))).alias("i"))
        return rows.select(name, F.expr(f"substring(piece, i, {k})").alias("word"), (F.col("p") + F.col("i") - 2).cast("long").alias(f"{name}_at"))

    own, other = words(queries, "src"), words(targets, "tgt")
    own = own.where(F.col("word") == F.upper("word")) if masked else own
    own, other = (x.withColumn("word", F.upper("word")) for x in (own, other))
    met = other.join(own.select("word"), "word", "left_semi").withColumn("n", F.count("*").over(Window.partitionBy("word"))).where(F.col("n") <= most)
    both = own.join(met, "word").select("src", "tgt", "src_at", (F.col("tgt_at") - F.col("src_at")).alias("diagonal"))
    line = F.row_number().over(Window.partitionBy("src", "tgt", "diagonal").orderBy("src_at"))
    runs = both.withColumn("run", F.col("src_at") - line).groupBy("src", "tgt", "diagonal", "run").agg(F.min("src_at").alias("start"), (F.max("src_at") + k).alias("stop"))
    return runs.select("src", "start", "stop", "tgt", (F.col("start") + F.col("diagonal")).alias("tgt_start"), (F.col("stop") + F.col("diagonal")).alias("tgt_stop"))
