"""Queries of annotations and of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequences as sq
from strandloom.operators import annotation as an
from strandloom.plans import views as v
from strandloom.plans.base import query
from strandloom.sources import blast

C = F.col


def _seqs(s: SparkSession, d: str) -> DataFrame:
    return v.seqs(s, d).withColumnRenamed("doc_id", "seq_id")


def _given(s: SparkSession, d: str) -> DataFrame:
    """Stretches of the sequences of documents, named by order; some are empty and some of no document."""
    o = v.t(s, d, "orders")
    return o.select(C("o_orderkey").alias("id"), (C("o_custkey") % 1500).alias("seq_id"), (C("o_orderkey") % 50).alias("start"), (C("o_orderkey") % 50 + C("o_custkey") % 9).alias("stop"), F.when(C("o_orderkey") % 3 == 0, -1).otherwise(1).alias("orientation"), C("o_orderstatus").alias("kind"))


_GIVEN = "(SELECT o_orderkey AS id, o_custkey % 1500 AS seq_id, o_orderkey % 50 AS low, o_orderkey % 50 + o_custkey % 9 AS high, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS ori, o_orderstatus AS kind FROM orders)"
_SIGNED = f"(SELECT id, seq_id, CASE WHEN ori < 0 AND low >= 0 THEN -high ELSE low END AS start, CASE WHEN ori < 0 AND low >= 0 THEN -low ELSE high END AS stop, kind FROM {_GIVEN} WHERE low < high AND seq_id IN (SELECT doc_id FROM seqs))"


@query(f"SELECT * FROM {_SIGNED}")
def an_build(s, d):
    """Annotations signed by their orientation; what is empty or of no known sequence is left out, and what is left passes the strict form."""
    found = an.build(_given(s, d), _seqs(s, d), strict=False)
    return an.build(found, _seqs(s, d)).drop("orientation")


@query(f"SELECT id, start + 1 AS start, least(start + 4, stop) AS stop FROM {_SIGNED} WHERE start + 1 < least(start + 4, stop)")
def an_slice(s, d):
    found = an.build(_given(s, d), _seqs(s, d), strict=False)
    x = found.select("id", an.slice_of(C("start"), C("stop"), F.lit(1), F.lit(4)).alias("x")).where("x is not null")
    return x.select("id", "x.*")


@query(f"SELECT id, seq_id, start, stop, kind FROM {_SIGNED} WHERE id % 10 <> 0 UNION ALL SELECT c_custkey * 10, doc_id, 0, length(seq), 'new' FROM customer JOIN seqs ON doc_id = c_custkey WHERE c_custkey % 5 = 0")
def an_add(s, d):
    """New annotations, which take the place of those with their ids."""
    found = an.build(_given(s, d), _seqs(s, d), strict=False).where("id % 10 <> 0").select("id", "seq_id", "start", "stop", "kind")
    new = v.t(s, d, "customer").where("c_custkey % 5 = 0").join(v.seqs(s, d), C("doc_id") == C("c_custkey"))
    new = new.select((C("c_custkey") * 10).alias("id"), C("doc_id").alias("seq_id"), F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("stop"), F.lit("new").alias("kind"))
    return an.added(found, new, _seqs(s, d))


@query(f"SELECT a.id, a.kind, CASE WHEN start >= 0 THEN substr(seq, start + 1, stop - start) ELSE reverse(translate(substr(seq, -stop + 1, stop - start), 'acgt', 'tgca')) END AS seq FROM {_SIGNED} a JOIN seqs ON doc_id = seq_id")
def an_letters(s, d):
    return an.letters(an.build(_given(s, d), _seqs(s, d), strict=False), _seqs(s, d)).select("id", "kind", "seq")


@query(f"SELECT o.id, e.id AS ann_id, e.kind FROM (SELECT doc_id AS id, doc_id AS seq_id, 10 AS a, 20 AS b FROM seqs) o JOIN {_SIGNED} e ON o.seq_id = e.seq_id AND o.a < CASE WHEN e.start < 0 THEN -e.start ELSE e.stop END AND CASE WHEN e.start < 0 THEN -e.stop ELSE e.start END < o.b")
def an_attributes(s, d):
    """What overlaps letters 10 to 20 of each sequence, with an attribute of the annotation."""
    from strandloom.operators.overlap import overlap_join

    found = an.build(_given(s, d), _seqs(s, d), strict=False).select("id", "seq_id", "start", "stop", "kind")
    spans = v.seqs(s, d).select(C("doc_id").alias("id"), C("doc_id").alias("seq_id"), F.lit(10).cast("long").alias("start"), F.lit(20).cast("long").alias("stop"))
    hits = overlap_join(spans, found.drop("kind"), "seq_id").select(C("l_id").alias("id"), C("r_id").alias("ann_id"))
    return an.with_attributes(hits, found, "kind").select("id", "ann_id", "kind")


@query("SELECT doc_id || ':' || CASE WHEN o < 0 THEN '-' ELSE '' END || (f - 1) AS id, doc_id AS seq_id, f * o AS frame, CASE WHEN o > 0 THEN f - 1 ELSE -(n - (n - f + 1) % 3) END AS start, CASE WHEN o > 0 THEN n - (n - f + 1) % 3 ELSE -(f - 1) END AS stop FROM (SELECT doc_id, length(seq) AS n FROM seqs), (VALUES (1), (2), (3)) a(f), (VALUES (1), (-1)) b(o) WHERE n >= f + 2")
def an_frames(s, d):
    return an.frames(_seqs(s, d))


_WORDS = "w AS (SELECT doc_id, i AS pos, substr(seq, i + 1, 14) AS word FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 13)) AS i FROM seqs WHERE length(seq) >= 14))"
_RUNS = f"{_WORDS}, met AS (SELECT a.doc_id AS src, b.doc_id AS tgt, a.pos, b.pos - a.pos AS diagonal FROM w a JOIN w b ON a.word = b.word AND a.doc_id <> b.doc_id WHERE a.doc_id % 20 = 0 AND a.word IN (SELECT word FROM w GROUP BY word HAVING count(*) <= 50)), runs AS (SELECT src, min(pos) AS start, max(pos) + 14 AS stop, tgt, min(pos) + diagonal AS tgt_start, max(pos) + 14 + diagonal AS tgt_stop FROM (SELECT *, pos - row_number() OVER (PARTITION BY src, tgt, diagonal ORDER BY pos) AS run FROM met) GROUP BY src, tgt, diagonal, run)"


def _hits(s: SparkSession, d: str) -> DataFrame:
    """The sequences of every twentieth document, a set of queries, searched for in all."""
    q = _seqs(s, d)
    return blast.seeds(q.where("seq_id % 20 = 0"), q, 14, 50).where("src <> tgt")


@query(f"WITH {_RUNS} SELECT * FROM runs")
def hm_seeds(s, d):
    return _hits(s, d)


@query(f"WITH {_RUNS}, long AS (SELECT * FROM runs WHERE stop - start >= 15), n AS (SELECT src, count(*) AS n FROM long GROUP BY src) SELECT CASE WHEN n > 1 THEN src || '_' || (row_number() OVER (PARTITION BY src ORDER BY start, tgt, tgt_start, tgt_stop) - 1) ELSE src::VARCHAR END AS id, tgt AS seq_id, tgt_start AS start, tgt_stop AS stop FROM long JOIN n USING (src)")
def an_homology(s, d):
    """Hits of 15 letters or more as annotations of what they hit."""
    hits = _hits(s, d).withColumn("length", F.lit(20))
    return an.from_hits(hits, max_loss=5)


@query("SELECT doc_id, CASE WHEN q = 2 AND t = 2 THEN 'blastp' WHEN q = 2 THEN 'tblastn' WHEN t = 2 THEN 'blastx' ELSE 'blastn' END AS program FROM (SELECT doc_id, doc_id % 3 AS q, doc_id // 3 % 3 AS t FROM documents)")
def hm_program(s, d):
    x = v.t(s, d, "documents")
    return x.select("doc_id", blast.program(C("doc_id") % 3, F.floor(C("doc_id") / 3) % 3).alias("program"))


@query("WITH f AS (SELECT doc_id, f, o, CASE WHEN o > 0 THEN f ELSE -(n - (n - f) % 3) END AS a, CASE WHEN o > 0 THEN n - (n - f) % 3 ELSE -f END AS z FROM (SELECT doc_id, length(seq) AS n FROM seqs), (VALUES (0), (1), (2)) x(f), (VALUES (1), (-1)) y(o) WHERE n >= f + 3), h AS (SELECT doc_id, doc_id % 5 AS start, doc_id % 5 + 9 AS stop FROM seqs UNION ALL SELECT doc_id, -(doc_id % 5 + 9), -(doc_id % 5) FROM seqs) SELECT f.doc_id || ':' || CASE WHEN o < 0 THEN '-' ELSE '' END || f AS src, (start - a) // 3 AS start, (stop - a) // 3 AS stop FROM h JOIN f ON h.doc_id = f.doc_id AND start >= a AND stop <= z AND (start >= 0) = (a >= 0) AND (start - a) % 3 = 0")
def hm_frames(s, d):
    """Hits on either strand, each in the frame that it lies in, in amino acids."""
    q = _seqs(s, d)
    low = C("seq_id") % 5
    hits = q.select(C("seq_id").alias("src"), low.alias("start"), (low + 9).alias("stop")).union(q.select("seq_id", -(low + 9), -low))
    return an.frame_hits(hits, an.frames(q))


@query("SELECT doc_id, f * o AS frame, length(seq) AS letters, (z - a) // 3 AS codons FROM (SELECT doc_id, seq, f, o, f - 1 AS a, length(seq) - (length(seq) - f + 1) % 3 AS z FROM seqs, (VALUES (1), (2), (3)) x(f), (VALUES (1), (-1)) y(o) WHERE length(seq) >= f + 2)")
def an_frame_proteins(s, d):
    """How many amino acids each of the six frames gives."""
    q = _seqs(s, d)
    own = an.frames(q).join(q, "seq_id")
    return own.select(C("seq_id").alias("doc_id"), "frame", F.length("seq").cast("long").alias("letters"), F.length(sq.translated_slice(C("seq"), C("start"), C("stop"))).cast("long").alias("codons"))


@query(f"SELECT id, id IN (SELECT id FROM {_SIGNED}) AS known FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT -1)")
def an_contains(s, d):
    """Which ids have an annotation, and which not."""
    found = an.build(_given(s, d), _seqs(s, d), strict=False)
    ids = v.t(s, d, "orders").select(C("o_orderkey").alias("id")).union(s.createDataFrame([(-1,)], "id long"))
    return an.contains(found, ids)


@query(f"WITH {_WORDS}, met AS (SELECT a.doc_id AS src, b.doc_id AS tgt, a.pos, b.pos - a.pos AS diagonal FROM w a JOIN w b ON a.word = b.word AND a.doc_id <> b.doc_id WHERE a.doc_id % 20 = 0 AND a.pos >= 100 AND a.word IN (SELECT word FROM w GROUP BY word HAVING count(*) <= 50)) SELECT src, min(pos) AS start, max(pos) + 14 AS stop, tgt, min(pos) + diagonal AS tgt_start, max(pos) + 14 + diagonal AS tgt_stop FROM (SELECT *, pos - row_number() OVER (PARTITION BY src, tgt, diagonal ORDER BY pos) AS run FROM met) GROUP BY src, tgt, diagonal, run")
def hm_masked_seeds(s, d):
    """The same search with the first hundred letters of each query masked as repeats."""
    q = _seqs(s, d)
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.least(F.length("seq"), F.lit(100)).cast("long").alias("stop")))
    queries = q.where("seq_id % 20 = 0").withColumn("seq", sq.soft_masked(C("seq"), span))
    return blast.seeds(queries, q, 14, 50, masked=True).where("src <> tgt")
