"""Queries that write a format and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.plans import views as v
from strandloom.plans.base import query
from strandloom.sources import blast, fasta, multiple, tabular
from strandloom.sources.shared import shared_folder

C = F.col


@query("SELECT doc_id::VARCHAR AS seq_id, seq, length(seq)::INTEGER AS length FROM seqs")
def src_fasta(s, d):
    folder = shared_folder(s, "fasta")
    fasta.write(v.seqs(s, d).select(C("doc_id").cast("string").alias("seq_id"), "seq"), folder)
    return fasta.checked(fasta.read(s, folder, strict=True)).select("seq_id", "seq", "length")


@query("SELECT doc_id::VARCHAR AS seq_id, seq FROM seqs")
def src_csv(s, d):
    folder = shared_folder(s, "csv")
    v.seqs(s, d).write.csv(folder)
    return fasta.read_csv(s, folder).select("seq_id", "seq")


@query("SELECT doc_id AS seq_id, a AS start, b AS stop, substr(seq, a + 1, b - a) AS part FROM (SELECT doc_id, seq, doc_id % 40 AS a, length(seq) - doc_id % 7 AS b FROM seqs) WHERE a < b")
def src_chunks(s, d):
    """Parts of sequences that are kept in pieces of 64 letters."""
    q = v.seqs(s, d).withColumnRenamed("doc_id", "seq_id")
    spans = q.select("seq_id", (C("seq_id") % 40).alias("start"), (F.length("seq") - C("seq_id") % 7).cast("long").alias("stop")).where("start < stop")
    return fasta.parts(fasta.chunked(q, 64), spans, 64)


@query("SELECT 'd.' || src AS seq_id, start, start + 10 AS stop, 0::BIGINT AS col_start, 10::BIGINT AS col_stop FROM blocks UNION ALL SELECT 'd.' || src, start + 10, start + 20, 12, 22 FROM blocks UNION ALL SELECT 't.' || tgt, tgt_start - CASE WHEN tgt_start < 0 THEN 2 ELSE 0 END, tgt_stop + CASE WHEN tgt_start < 0 THEN 0 ELSE 2 END, 0, 22 FROM blocks")
def src_maf(s, d):
    """Blocks of two rows, of which the first has a gap of two columns."""
    folder, q = shared_folder(s, "maf"), v.seqs(s, d).select("doc_id", "seq")
    b = v.blocks(s, d).join(q.select(C("doc_id").alias("src"), C("seq").alias("a")), "src").join(q.select(C("doc_id").alias("tgt"), F.length("seq").alias("n")), "tgt")
    minus = C("tgt_start") < 0
    at = F.when(minus, C("n") + C("tgt_start") - 2).otherwise(C("tgt_start"))
    letters = F.concat(F.expr("substring(a, int(start) + 1, 10)"), F.lit("--"), F.expr("substring(a, int(start) + 11, 10)"))
    one = F.concat_ws(" ", F.lit("s"), F.concat(F.lit("d."), "src"), "start", F.lit(20), F.lit("+"), F.length("a"), letters)
    two = F.concat_ws(" ", F.lit("s"), F.concat(F.lit("t."), "tgt"), at, F.lit(22), F.when(minus, "-").otherwise("+"), "n", F.repeat(F.lit("a"), F.lit(22)))
    b.select(F.concat(F.lit("##maf version=1\n\na score=0\n"), one, F.lit("\n"), two, F.lit("\n")).alias("value")).write.text(folder)
    return multiple.read_maf(s, folder).select("seq_id", "start", "stop", "col_start", "col_stop")


@query("SELECT 'd.' || src AS src, start + a AS start, start + a + 10 AS stop, 't.' || tgt AS tgt, tgt_start - CASE WHEN tgt_start < 0 THEN 2 ELSE 0 END + c AS tgt_start, tgt_start - CASE WHEN tgt_start < 0 THEN 2 ELSE 0 END + c + 10 AS tgt_stop FROM blocks, (VALUES (0, 0), (10, 12)) v(a, c)")
def src_maf_pairs(s, d):
    """The same blocks as pairs of stretches."""
    folder, q = shared_folder(s, "maf"), v.seqs(s, d).select("doc_id", "seq")
    b = v.blocks(s, d).join(q.select(C("doc_id").alias("tgt"), F.length("seq").alias("n")), "tgt")
    minus = C("tgt_start") < 0
    at = F.when(minus, C("n") + C("tgt_start") - 2).otherwise(C("tgt_start"))
    one = F.concat_ws(" ", F.lit("s"), F.concat(F.lit("d."), "src"), "start", F.lit(20), F.lit("+"), F.lit(99999), F.lit("aaaaaaaaaa--aaaaaaaaaa"))
    two = F.concat_ws(" ", F.lit("s"), F.concat(F.lit("t."), "tgt"), at, F.lit(22), F.when(minus, "-").otherwise("+"), "n", F.repeat(F.lit("a"), F.lit(22)))
    b.select(F.concat(F.lit("a score=0\n"), one, F.lit("\n"), two, F.lit("\n")).alias("value")).write.text(folder)
    return multiple.pairs(multiple.read_maf(s, folder, header=False), "d.")


@query("SELECT 'x.' || src AS src, start + a AS start, start + a + 10 AS stop, 'y.' || tgt AS tgt, tgt_start - CASE WHEN tgt_start < 0 THEN 2 ELSE 0 END + c AS tgt_start, tgt_start - CASE WHEN tgt_start < 0 THEN 2 ELSE 0 END + c + 10 AS tgt_stop FROM blocks, (VALUES (0, 0), (10, 12)) v(a, c)")
def src_axt(s, d):
    folder, q = shared_folder(s, "axt"), v.seqs(s, d).select("doc_id", F.length("seq").cast("long").alias("n"))
    lengths = q.select(F.concat(F.lit("x."), C("doc_id")).alias("seq_id"), C("n").alias("length")).union(q.select(F.concat(F.lit("y."), C("doc_id")), "n"))
    b = v.blocks(s, d).join(q.withColumnRenamed("doc_id", "tgt"), "tgt")
    minus = C("tgt_start") < 0
    at = F.when(minus, C("n") + C("tgt_start") - 2).otherwise(C("tgt_start")) + 1
    line = F.concat_ws(" ", F.lit(0), C("src"), C("start") + 1, C("start") + 20, C("tgt"), at, at + 21, F.when(minus, "-").otherwise("+"), F.lit(99))
    b.select(F.concat(line, F.lit("\naaaaaaaaaa--aaaaaaaaaa\n"), F.repeat(F.lit("a"), F.lit(22)), F.lit("\n")).alias("value")).write.text(folder)
    return multiple.read_axt(s, folder, lengths, "x.", "y.")


@query("SELECT 'q' || src AS src, start + a AS start, start + a + n AS stop, 't' || tgt AS tgt, CASE WHEN tgt % 2 = 0 THEN 500 + start + c ELSE -(500 + start + 18 - c) END AS tgt_start, CASE WHEN tgt % 2 = 0 THEN 500 + start + c + n ELSE -(500 + start + 18 - c - n) END AS tgt_stop FROM (SELECT DISTINCT src, tgt, start FROM blocks), (VALUES (0, 0, 8), (10, 8, 10)) v(a, c, n)")
def src_blast(s, d):
    """A report of one alignment for each block, with a gap of two letters in the subject, of odd ones on the other strand."""
    folder = shared_folder(s, "blast")
    b = v.blocks(s, d).select("src", "tgt", "start").distinct()
    even = C("tgt") % 2 == 0
    line = lambda name, a, letters, z: F.concat(F.lit(f"{name}: "), a, F.lit(f" {letters} "), z, F.lit("\n"))
    ends = lambda low, high: (F.when(even, low).otherwise(high), F.when(even, high).otherwise(low))
    a, z = ends(C("start") + 501, C("start") + 518)
    text = F.concat(
        F.lit("Query= q"), C("src"), F.lit(" title\n         (20 letters)\n\n>t"), C("tgt"), F.lit("\n          Length = 999\n\n Score = 38.2 bits (19), Expect = 2e-05\n Identities = 18/20 (90%)\n\n"),
        line("Query", C("start") + 1, "aaaaaaaaaaaaaaaaaaaa", C("start") + 20), F.lit("       |||\n"), line("Sbjct", a, "aaaaaaaa--aaaaaaaaaa", z), F.lit("\n  Database: all"),
    )
    b.select(text.alias("value")).write.text(folder)
    return blast.as_alignment(blast.read(s, folder), lambda hits: hits.where("percent_id >= 90 and e_value > 4"))


@query("SELECT start, stop, tgt, tgt_start, tgt_stop FROM aln")
def src_intervals(s, d):
    folder = shared_folder(s, "intervals")
    v.aln(s, d).select(F.concat_ws(" ", "start", "stop", "tgt", "tgt_start", "tgt_stop").alias("value")).write.text(folder)
    return tabular.read_intervals(s, folder)


@query("SELECT * FROM aln")
def src_tuples(s, d):
    """Rows with names of their own and a strand beside forward ends."""
    a = v.aln(s, d)
    low, high = F.when(C("tgt_start") < 0, -C("tgt_stop")).otherwise(C("tgt_start")), F.when(C("tgt_start") < 0, -C("tgt_start")).otherwise(C("tgt_stop"))
    rows = a.select(C("src").alias("q"), C("start").alias("q0"), C("stop").alias("q1"), C("tgt").alias("t"), low.alias("t0"), high.alias("t1"), F.when(C("tgt_start") < 0, -1).otherwise(1).alias("strand"))
    return tabular.from_tuples(rows, {"id": "q", "start": "q0", "stop": "q1", "idDest": "t", "startDest": "t0", "stopDest": "t1", "oriDest": "strand"})


@query("SELECT * FROM aln")
def src_dump(s, d):
    folder = shared_folder(s, "dump")
    tabular.write_dump(v.aln(s, d), folder)
    return tabular.read_dump(s, folder, "long")


@query("SELECT * FROM aln WHERE src = 7 AND start BETWEEN 3500 AND 5000")
def src_sorted(s, d):
    """Part of an alignment that is kept by source and place: the scan is told both."""
    folder = shared_folder(s, "sorted")
    tabular.write_sorted(v.aln(s, d), folder)
    return s.read.parquet(folder).where("src = 7 and start between 3500 and 5000")


@query("SELECT o_custkey AS key, max(o_orderkey) AS value FROM orders GROUP BY o_custkey")
def src_shelf(s, d):
    """Values by key, written twice over: the later ones stand."""
    shelf = tabular.Shelf(s, shared_folder(s, "shelf"), "c")
    o = v.t(s, d, "orders").groupBy(C("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("value"))
    shelf.put(o.withColumn("value", C("value") - 1))
    shelf.put(o)
    return shelf.all()


@query("SELECT doc_id::VARCHAR AS seq_id, length(seq)::INTEGER AS length FROM seqs")
def src_lengths(s, d):
    """Lengths alone, of compressed files."""
    folder = shared_folder(s, "fasta")
    records = v.seqs(s, d).select(F.concat(F.lit(">"), C("doc_id").cast("string"), F.lit(" a title\n"), F.regexp_replace("seq", "(.{50})(?=.)", "$1\n")).alias("value"))
    records.write.option("compression", "gzip").text(folder)
    return fasta.read(s, folder).select("seq_id", "length")


@query("SELECT seq, count(*) AS n FROM seqs GROUP BY seq")
def src_automatic_ids(s, d):
    """Sequences written without ids get different ones."""
    folder = shared_folder(s, "fasta")
    fasta.write(v.seqs(s, d).select(F.lit(None).cast("string").alias("seq_id"), "seq"), folder)
    back = fasta.read(s, folder)
    return back.groupBy("seq").agg(F.countDistinct("seq_id").alias("n"))


@query("SELECT src, count(*) AS n, sum(stop - start)::BIGINT AS letters FROM aln GROUP BY src")
def src_table(s, d):
    """A table of the catalog, bucketed by what it is grouped by: the second reading needs no shuffle."""
    folder = shared_folder(s, "table")
    name = f"aln_{folder.rsplit('-', 1)[-1]}"
    tabular.save_table(v.aln(s, d), name, ["src"], path=folder)
    return s.table(name).groupBy("src").agg(F.count("*").alias("n"), F.sum(C("stop") - C("start")).alias("letters"))


@query("SELECT a.exon AS src, b.exon AS dst FROM exons a JOIN exons b ON a.cluster = b.cluster AND b.start = a.start + 20 WHERE a.exon <> b.exon")
def src_splice_graph(s, d):
    """Exons and splices from files, as a graph."""
    from strandloom.operators.graph import load_splice_graph

    folder, at = shared_folder(s, "splices"), C("o_orderkey") % 40 * 10
    e = v.t(s, d, "orders").select((C("o_custkey") % 200).alias("cluster"), C("o_orderkey").alias("exon"), at.alias("start"), (at + 5).alias("stop"))
    e.write.parquet(f"{folder}/exons")
    e.select("cluster", "start", "stop").distinct().select("cluster", F.xxhash64("cluster", "start").alias("splice"), C("stop").alias("start"), (C("start") + 20).alias("stop")).write.parquet(f"{folder}/splices")
    return load_splice_graph(s, f"{folder}/exons", f"{folder}/splices")[0].edges.where("src <> dst").select("src", "dst")
