"""Queries of sequence and interval functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions import sequences as sq
from strandloom.plans import views as v
from strandloom.plans.base import query

C = F.col

_WILD = dict(sq.CODONS)
for _pair in {c[:2] for c in sq.CODONS}:
    _four = [sq.CODONS[_pair + x] for x in "TCAG"]
    if len(set(_four)) == 1:
        _WILD[_pair + "N"] = _four[0]
    else:
        _WILD |= {_pair + y: a for y, a, b in (("Y", _four[0], _four[1]), ("R", _four[2], _four[3])) if a == b}
_CODONS = "MAP {" + ", ".join(f"'{k}': '{a}'" for k, a in _WILD.items()) + "}"


@query(f"SELECT doc_id, list_aggregate(list_transform(range(0, length(seq), 3), lambda i: coalesce(m[replace(upper(substr(seq, i + 1, 3)), 'U', 'T')], 'X')), 'string_agg', '') AS protein FROM (SELECT doc_id, regexp_replace(text, '[^acgtunry]', '', 'g') AS seq, {_CODONS} AS m FROM documents) WHERE seq <> ''")
def seq_translate_wild(s, d):
    """Codons with letters that stand for several."""
    x = v.t(s, d, "documents").select("doc_id", F.regexp_replace("text", "[^acgtunry]", "").alias("seq")).where("seq <> ''")
    return x.select("doc_id", sq.translate(C("seq")).alias("protein"))


_KIND = "CASE WHEN length(regexp_replace(u, '[^ATUGCN]', '', 'g')) / length(u) > 0.85 THEN CASE WHEN length(regexp_replace(u, '[^T]', '', 'g')) > length(regexp_replace(u, '[^U]', '', 'g')) THEN 0 ELSE 1 END ELSE 2 END"


@query(f"SELECT doc_id, {_KIND} AS kind FROM (SELECT doc_id, upper(substr(x, 4, 40)) AS u FROM (SELECT doc_id, regexp_replace(text, '[^a-z]', '', 'g') AS x FROM documents) WHERE length(x) > 3)")
def seq_interval_type(s, d):
    """The alphabet of an interval, by its first 40 letters."""
    x = v.t(s, d, "documents").select("doc_id", F.regexp_replace("text", "[^a-z]", "").alias("x")).where("length(x) > 3")
    return x.select("doc_id", sq.interval_type(C("x"), F.lit(3), F.length("x")).alias("kind"))


@query("SELECT id, greatest((stop - start) // 3, 1) AS codons FROM iv_orders")
def seq_length(s, d):
    return v.iv_orders(s, d).select("id", iv.size(C("start"), C("stop"), 3).alias("codons"))


@query("SELECT doc_id, i AS pos, substr(seq, i + 1, 1) AS letter, nullif(substr(seq, i + 2, 1), '') AS next FROM (SELECT *, unnest(range(0, length(seq)))::INTEGER AS i FROM seqs)")
def seq_letter_chain(s, d):
    return v.seqs(s, d).select("doc_id", F.explode(sq.letters(C("seq"))).alias("x")).select("doc_id", "x.*")


@query("SELECT DISTINCT a.src, a.tgt, b.start AS next_start FROM aln a JOIN aln b ON a.tgt = b.tgt AND a.tgt_stop = b.tgt_start AND (a.tgt_start < 0) = (b.tgt_start < 0)")
def seq_edge_sequences(s, d):
    """Sequences that go on over an edge of the axis: an interval ends where another, of the same strand, begins."""
    a = v.aln(s, d)
    ends = a.select("src", "tgt", C("tgt_stop").alias("at"), (C("tgt_start") < 0).alias("minus"))
    return ends.join(a.select("tgt", C("tgt_start").alias("at"), (C("tgt_start") < 0).alias("minus"), C("start").alias("next_start")), ["tgt", "at", "minus"]).select("src", "tgt", "next_start").distinct()


@query(f"SELECT doc_id, list_aggregate(list_transform(range(0, n, 3), lambda i: coalesce(m[upper(substr(x, i + 1, 3))], 'X')), 'string_agg', '') AS protein FROM (SELECT doc_id, x, length(x) // 3 * 3 AS n, {_CODONS} AS m FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(seq, doc_id % 3 + 1, length(seq)) ELSE reverse(translate(substr(seq, 1, length(seq) - doc_id % 3), 'acgt', 'tgca')) END AS x FROM seqs WHERE length(seq) > 6))")
def seq_protein_slice(s, d):
    """The protein of an interval, of whole codons in the interval's own frame."""
    n, f, even = F.length("seq").cast("long"), C("doc_id") % 3, C("doc_id") % 2 == 0
    x = v.seqs(s, d).where("length(seq) > 6")
    return x.select("doc_id", sq.translated_slice(C("seq"), F.when(even, f).otherwise(f - n), F.when(even, n).otherwise(F.lit(0))).alias("protein"))


@query("SELECT id, (i // 3)::BIGINT AS aa_start, (j // 3)::BIGINT AS aa_stop, start + 3 * (i // 3) AS start, start + 3 * (j // 3) AS stop FROM (SELECT *, id % 7 AS i, stop - start AS j FROM iv_events) WHERE j > i")
def seq_codon_places(s, d):
    """Which amino acids a stretch of nucleotides covers, and back."""
    e = v.iv_events(s, d).where("stop - start > id % 7")
    aa = sq.protein_slice(C("start"), C("stop"), C("start") + C("id") % 7, C("stop"))
    nt = sq.nucleotide_slice(C("start"), aa["start"], aa["stop"])
    return e.select("id", aa["start"].alias("aa_start"), aa["stop"].alias("aa_stop"), nt["start"].alias("start"), nt["stop"].alias("stop"))


@query("SELECT doc_id, substr(seq, 1, 4) || substr(seq, 7, 3) || substr(seq, 10, length(seq) - 9) AS exons FROM seqs WHERE length(seq) > 9")
def seq_spliced(s, d):
    x = v.seqs(s, d).where("length(seq) > 9")
    return x.select("doc_id", sq.spliced(C("seq"), F.lit("0,6,9,"), F.concat(F.lit("4,9,"), F.length("seq").cast("string"), F.lit(","))).alias("exons"))


@query("SELECT doc_id, upper(substr(seq, 1, 2)) || lower(substr(seq, 3, 4)) || upper(substr(seq, 7, length(seq))) AS masked FROM seqs WHERE length(seq) > 6")
def seq_soft_mask(s, d):
    span = F.array(F.struct(F.lit(2).cast("long").alias("start"), F.lit(5).cast("long").alias("stop")), F.struct(F.lit(4).cast("long").alias("start"), F.lit(6).cast("long").alias("stop")))
    return v.seqs(s, d).where("length(seq) > 6").select("doc_id", sq.soft_masked(C("seq"), span).alias("masked"))


@query("SELECT id, CASE WHEN lo < 0 THEN -start + lo ELSE start + lo END AS start, CASE WHEN lo < 0 THEN -start + lo + 9 ELSE start + lo + 9 END AS stop FROM (SELECT *, id % 40 - 12 AS lo FROM iv_events) WHERE lo >= 0 OR lo <= -9")
def iv_relative_slice(s, d):
    low = C("id") % 40 - 12
    e = v.iv_events(s, d).where((low >= 0) | (low <= -9))
    return e.select("id", iv.relative_slice(C("start"), C("stop"), low, low + 9).alias("x")).select("id", "x.*")


@query("SELECT id, start = 0 AND stop = 30 OR start = -30 AND stop = 0 AS whole FROM (SELECT id, CASE WHEN id % 2 = 0 THEN start % 2 ELSE -30 END AS start, CASE WHEN id % 2 = 0 THEN 30 ELSE -(start % 2) END AS stop FROM iv_orders)")
def iv_full_length(s, d):
    even = C("id") % 2 == 0
    o = v.iv_orders(s, d).select("id", F.when(even, C("start") % 2).otherwise(-30).alias("start"), F.when(even, 30).otherwise(-(C("start") % 2)).alias("stop"))
    return o.select("id", iv.is_full_length(C("start"), C("stop"), F.lit(30)).alias("whole"))


@query("SELECT a.src AS l_id, b.src AS r_id, a.tgt, a.tgt_start FROM aln a JOIN aln b ON a.tgt = b.tgt AND a.tgt_start = b.tgt_start AND a.tgt_stop = b.tgt_stop AND a.src < b.src")
def iv_equal(s, d):
    """Intervals that are the same stretch of one sequence."""
    a = v.aln(s, d).select("src", iv.order_key(C("tgt"), C("tgt_start"), C("tgt_stop")).alias("at"))
    return a.withColumnRenamed("src", "l_id").join(a.withColumnRenamed("src", "r_id"), "at").where("l_id < r_id").select("l_id", "r_id", C("at.seq").alias("tgt"), C("at.start").alias("tgt_start"))


@query("SELECT id, seq, row_number() OVER (PARTITION BY seq ORDER BY start, stop, id)::INTEGER AS place FROM iv_events")
def iv_order(s, d):
    """The order of intervals of one sequence: by start, then by stop."""
    key = iv.order_key(C("seq"), C("start"), C("stop"))
    return v.iv_events(s, d).select("id", "seq", F.row_number().over(Window.partitionBy("seq").orderBy(key, "id")).alias("place"))


@query("SELECT src, tgt, start, tgt_start + (greatest(start, start + 2) - start) * 3 AS a, tgt_start + (least(stop, start + 7) - start) * 3 AS b FROM aln WHERE stop - start > 2")
def iv_clip_transform(s, d):
    """Letters 2 to 7 of each interval, clipped to it, on a target three times as long."""
    x = iv.clip_transformed(C("start") + 2, C("start") + 7, C("start"), C("stop"), C("tgt_start"), C("tgt_start") + 3 * (C("stop") - C("start")))
    return v.aln(s, d).where("stop - start > 2").select("src", "tgt", "start", x["start"].alias("a"), x["stop"].alias("b"))


@query("SELECT src AS src_id, start AS src_start, stop AS src_end, 1 AS src_ori, tgt AS dest_id, CASE WHEN tgt_start < 0 THEN -tgt_stop ELSE tgt_start END AS dest_start, CASE WHEN tgt_start < 0 THEN -tgt_start ELSE tgt_stop END AS dest_end, CASE WHEN tgt_start < 0 THEN -1 ELSE 1 END AS dest_ori FROM aln")
def iv_record(s, d):
    return v.aln(s, d).select(*iv.record(C("src"), C("start"), C("stop"), "src_"), *iv.record(C("tgt"), C("tgt_start"), C("tgt_stop"), "dest_"))


@query("SELECT tgt, src, CASE WHEN tgt_start < 0 THEN -tgt_stop ELSE tgt_start END AS start, CASE WHEN tgt_start < 0 THEN -tgt_start ELSE tgt_stop END AS stop, CASE WHEN tgt_start < 0 THEN -stop ELSE start END AS tgt_start, CASE WHEN tgt_start < 0 THEN -start ELSE stop END AS tgt_stop FROM aln")
def iv_reorient(s, d):
    """Alignments seen from the target, which is turned to be forward."""
    x = iv.reoriented(C("tgt_start"), C("tgt_stop"), C("start"), C("stop"))
    return v.aln(s, d).select("tgt", "src", x.alias("x")).select("tgt", "src", "x.*")
