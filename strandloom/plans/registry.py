"""The engine's own queries over the driver's tables, and SQL that returns the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions import sequences as sq
from strandloom.operators import alignment as al
from strandloom.operators import overlap, pattern, tables
from strandloom.operators.graph import Graph, last_wins, splice_graph
from strandloom.plans import alignments, annotations, graphs, sequences, sources, tabular  # noqa: F401  they add their queries
from strandloom.plans import views as v
from strandloom.plans.base import oracle_sql, queries, query, register  # noqa: F401

C = F.col


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Each order's interval with the customer's next one, the later of odd ids on the reverse strand."""
    line = Window.partitionBy("seq").orderBy("start", "id")
    p = v.iv_orders(s, d).select("*", F.lead("start").over(line).alias("b0"), F.lead("stop").over(line).alias("b1")).where("b0 is not null")
    odd = C("id") % 5 == 0
    return p.select("id", "seq", "start", "stop", F.when(odd, -C("b1")).otherwise(C("b0")).alias("b0"), F.when(odd, -C("b0")).otherwise(C("b1")).alias("b1"))


_PAIRS = "(SELECT id, seq, start, stop, CASE WHEN id % 5 = 0 THEN -n1 ELSE n0 END AS b0, CASE WHEN id % 5 = 0 THEN -n0 ELSE n1 END AS b1 FROM (SELECT *, lead(start) OVER w AS n0, lead(stop) OVER w AS n1 FROM iv_orders WINDOW w AS (PARTITION BY seq ORDER BY start, id)) WHERE n0 IS NOT NULL)"


# --- intervals


@query(f"SELECT id, greatest(start, b0) AS start, least(stop, b1) AS stop FROM {_PAIRS} WHERE b0 >= 0 AND greatest(start, b0) < least(stop, b1)")
def iv_intersect(s, d):
    p = _pairs(s, d)
    return p.select("id", iv.intersect(C("start"), C("stop"), C("b0"), C("b1")).alias("x")).where("x is not null").select("id", "x.*")


@query(f"SELECT id, least(start, b0) AS start, greatest(stop, b1) AS stop FROM {_PAIRS}")
def iv_span_union(s, d):
    return _pairs(s, d).select("id", iv.span(C("start"), C("stop"), C("b0"), C("b1")).alias("x")).select("id", "x.*")


@query("SELECT seq, min(start) AS start, max(stop) AS stop FROM iv_orders GROUP BY seq")
def iv_list_union(s, d):
    return overlap.covering(v.iv_orders(s, d).select("seq", "start", "stop"))


@query("SELECT src, tgt, -tgt_stop AS start, -tgt_start AS stop, CASE WHEN tgt_start >= 0 THEN 1 ELSE -1 END AS ori, abs(CASE WHEN tgt_start >= 0 THEN tgt_start ELSE tgt_stop END) AS low FROM aln")
def iv_flip(s, d):
    a = v.aln(s, d)
    f, b = iv.flip(C("tgt_start"), C("tgt_stop")), iv.absolute(C("tgt_start"), C("tgt_stop"))
    return a.select("src", "tgt", f["start"].alias("start"), f["stop"].alias("stop"), iv.orientation(C("tgt_start")).alias("ori"), b["start"].alias("low"))


@query(f"SELECT id, start < b1 AND b0 < stop AS overlaps, start <= b0 AND b1 <= stop AS contains FROM {_PAIRS}")
def iv_overlaps_contains(s, d):
    x = [C(c) for c in ("start", "stop", "b0", "b1")]
    return _pairs(s, d).select("id", iv.overlaps(*x).alias("overlaps"), iv.contains(*x).alias("contains"))


@query("SELECT id, CASE WHEN start > 0 THEN start END AS before_stop, CASE WHEN stop < 2500 THEN stop END AS after_start FROM iv_orders")
def iv_before_after(s, d):
    return v.iv_orders(s, d).select("id", iv.before(C("start"))["stop"].alias("before_stop"), iv.after(C("stop"), F.lit(2500))["start"].alias("after_start"))


@query("SELECT src, tgt, start, tgt_start + (size // 2) * 3 AS pos FROM (SELECT *, stop - start AS size FROM aln)")
def iv_transform(s, d):
    a = v.aln(s, d)
    x = C("start") + F.floor((C("stop") - C("start")) / 2)
    pos = iv.transformed(x, C("start"), C("stop"), C("tgt_start"), C("tgt_start") + 3 * (C("stop") - C("start")))
    return a.select("src", "tgt", "start", pos.alias("pos"))


@query("SELECT id, CASE WHEN i < j THEN start + i WHEN i > j THEN -(start + i) END AS start, CASE WHEN i < j THEN start + j WHEN i > j THEN -(start + j) END AS stop FROM (SELECT id, start, least(greatest(CASE WHEN lo < 0 THEN n + lo ELSE lo END, 0), n) AS i, least(greatest(CASE WHEN hi < 0 THEN n + hi ELSE hi END, 0), n) AS j FROM (SELECT id, start, stop - start AS n, id % 13 - 5 AS lo, id % 29 - 9 AS hi FROM iv_orders))")
def iv_slice(s, d):
    x = iv.sliced(C("start"), C("stop"), C("id") % 13 - 5, C("id") % 29 - 9)
    return v.iv_orders(s, d).select("id", x["start"].alias("start"), x["stop"].alias("stop"))


@query("SELECT o.id, greatest(o.start, m.lo) AS start, least(o.stop, m.hi) AS stop FROM iv_orders o JOIN (SELECT c_custkey AS seq, c_custkey % 1000 AS lo, c_custkey % 1000 + 900 AS hi FROM customer) m USING (seq) WHERE greatest(o.start, m.lo) < least(o.stop, m.hi)")
def iv_filter_mask(s, d):
    m = v.t(s, d, "customer").select(C("c_custkey").alias("seq"), (C("c_custkey") % 1000).alias("lo"), (C("c_custkey") % 1000 + 900).alias("hi"))
    twice = m.unionByName(m.withColumn("lo", C("lo") - 50)).withColumnsRenamed({"lo": "low", "hi": "high"})  # of two masks the last stands
    return overlap.masked(v.iv_orders(s, d), twice, order="low").select("id", "start", "stop")


# --- sequences


@query("SELECT doc_id, reverse(translate(seq, 'acgtunACGTUN', 'tgcaanTGCAAN')) AS rc FROM seqs")
def seq_revcomp(s, d):
    return v.seqs(s, d).select("doc_id", sq.reverse_complement(C("seq")).alias("rc"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(seq, length(seq) // 5 + 1, length(seq) - length(seq) // 5) ELSE reverse(translate(substr(seq, length(seq) // 5 + 1, length(seq) - length(seq) // 5), 'acgt', 'tgca')) END AS part FROM seqs")
def seq_substring_strand(s, d):
    """All but the first fifth of each sequence, of odd ids on the reverse strand."""
    even, n = C("doc_id") % 2 == 0, F.length("seq")
    low = F.floor(n / 5)
    return v.seqs(s, d).select("doc_id", sq.substring(C("seq"), F.when(even, low).otherwise(-n), F.when(even, n).otherwise(-low)).alias("part"))


_CODONS = "MAP {" + ", ".join(f"'{k}': '{a}'" for k, a in sq.CODONS.items()) + "}"


@query(f"SELECT doc_id, list_aggregate(list_transform(range(0, length(seq), 3), lambda i: coalesce(m[upper(substr(seq, i + 1, 3))], 'X')), 'string_agg', '') AS protein FROM (SELECT *, {_CODONS} AS m FROM seqs)")
def seq_translate(s, d):
    return v.seqs(s, d).select("doc_id", sq.translate(C("seq")).alias("protein"))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(u, '[^ATUGCN]', '', 'g')) / length(u) > 0.85 THEN CASE WHEN length(regexp_replace(u, '[^T]', '', 'g')) > length(regexp_replace(u, '[^U]', '', 'g')) THEN 0 ELSE 1 END WHEN length(u) > 0 THEN 2 END AS kind FROM (SELECT doc_id, upper(regexp_replace(text, '[^a-z]', '', 'g')) AS u FROM documents) WHERE length(u) > 0 UNION ALL SELECT doc_id, CASE WHEN length(regexp_replace(seq, '[^t]', '', 'g')) > 0 THEN 0 ELSE 1 END FROM seqs")
def seq_guess_type(s, d):
    text = v.t(s, d, "documents").select("doc_id", F.regexp_replace("text", "[^a-z]", "").alias("x")).where("x <> ''")
    return text.union(v.seqs(s, d)).select("doc_id", sq.guess_type(C("x")).alias("kind"))


@query("SELECT doc_id, f * o AS frame, CASE WHEN o > 0 THEN f - 1 ELSE -(n - (n - f + 1) % 3) END AS start, CASE WHEN o > 0 THEN n - (n - f + 1) % 3 ELSE -(f - 1) END AS stop FROM (SELECT doc_id, length(seq) AS n FROM seqs), (VALUES (1), (2), (3)) a(f), (VALUES (1), (-1)) b(o) WHERE n >= f + 2")
def seq_six_frames(s, d):
    return v.seqs(s, d).select("doc_id", F.explode(sq.six_frames(F.length("seq"))).alias("x")).select("doc_id", "x.*")


@query("SELECT edge, count(*) AS n FROM (SELECT substr(seq, i, 2) AS edge FROM (SELECT seq, unnest(range(1, length(seq))) AS i FROM seqs)) GROUP BY edge")
def seq_letter_edges(s, d):
    pairs = v.seqs(s, d).select(F.explode(sq.letters(C("seq"))).alias("x")).where("x.next is not null")
    return pairs.groupBy(F.concat("x.letter", "x.next").alias("edge")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(seq, i, 1) = substr(seq, length(seq) - i + 1, 1) THEN 1 ELSE 0 END))::INTEGER AS same FROM (SELECT *, length(seq) AS n FROM seqs)")
def seq_identity(s, d):
    return v.seqs(s, d).select("doc_id", sq.identity(C("seq"), F.reverse("seq")).alias("same"))


# --- joins


@query("SELECT a.id AS l_id, b.id AS r_id FROM iv_orders a JOIN iv_orders b ON a.seq = b.seq AND a.start < b.stop AND b.start < a.stop AND a.id < b.id")
def jn_overlap_self(s, d):
    o = v.iv_orders(s, d)
    return overlap.overlap_join(o, o).where("l_id < r_id").select("l_id", "r_id")


@query("SELECT a.id AS l_id, b.id AS r_id, greatest(a.start, b.start) AS clip_start, least(a.stop, b.stop) AS clip_stop FROM iv_orders a JOIN iv_orders b ON a.seq = b.seq AND a.start < b.stop AND b.start < a.stop AND a.id <> b.id")
def jn_overlap_clip(s, d):
    o = v.iv_orders(s, d)
    return overlap.clipped(overlap.overlap_join(o, o).where("l_id <> r_id")).select("l_id", "r_id", "clip_start", "clip_stop")


@query("SELECT a.id AS l_id, b.id AS r_id FROM iv_events a JOIN iv_events b ON a.seq = b.seq AND a.start < b.stop AND b.start < a.stop AND a.id <> b.id")
def jn_overlap_dense(s, d):
    e = v.iv_events(s, d)
    return overlap.overlap_join(e, e).where("l_id <> r_id").select("l_id", "r_id")


@query("SELECT a.id AS l_id, b.id AS r_id, -b.stop AS hit_start, -b.start AS hit_stop FROM iv_orders a JOIN iv_events b ON a.seq = b.seq AND a.start < b.stop AND b.start < a.stop")
def jn_overlap_two_tables(s, d):
    o = v.iv_orders(s, d).select("seq", "id", (-C("stop")).alias("start"), (-C("start")).alias("stop"))
    return overlap.overlap_join(o, v.iv_events(s, d)).select("l_id", "r_id", "hit_start", "hit_stop")


_TWO = "SELECT a.src, b.src AS tgt, a.start + greatest(a.tgt_start, b.tgt_start) - a.tgt_start AS start, b.start + greatest(a.tgt_start, b.tgt_start) - b.tgt_start AS tgt_start, least(a.tgt_stop, b.tgt_stop) - greatest(a.tgt_start, b.tgt_start) AS size FROM aln a JOIN aln b ON a.tgt = b.tgt AND a.tgt_start < b.tgt_stop AND b.tgt_start < a.tgt_stop WHERE NOT (a.src = b.src AND a.start + greatest(a.tgt_start, b.tgt_start) - a.tgt_start = b.start + greatest(a.tgt_start, b.tgt_start) - b.tgt_start)"


@query(_TWO)
def jn_two_hop(s, d):
    """Sources over the targets that they share; an interval does not meet itself."""
    a = v.aln(s, d).select("src", "start", C("tgt").alias("axis"), C("tgt_start").alias("low"), C("tgt_stop").alias("high"))
    return al.two_hop(a, a)


@query("SELECT q.src, q.start AS q_start, a.tgt, greatest(q.start, a.start) AS start, least(q.stop, a.stop) AS stop, a.tgt_start + greatest(q.start, a.start) - a.start AS tgt_start, a.tgt_stop + least(q.stop, a.stop) - a.stop AS tgt_stop FROM (SELECT s_suppkey AS src, 3000 AS start, 3100 AS stop FROM supplier UNION ALL SELECT s_suppkey, 4000, 4050 FROM supplier) q JOIN aln a ON a.src = q.src AND a.start < q.stop AND q.start < a.stop")
def jn_pairwise(s, d):
    """One hop: what stretches of sources are aligned to, cut to them; what an interval is aligned to is kept, itself included."""
    spans = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((3000, 3100), (4000, 4050))])).alias("x")
    q = v.t(s, d, "supplier").select(C("s_suppkey").alias("src"), spans).select("src", "x.*")
    x = overlap.clipped(overlap.overlap_join(q, v.aln(s, d), "src"))
    low, high = C("clip_start"), C("clip_stop")
    return x.select(C("l_src").alias("src"), C("l_start").alias("q_start"), C("r_tgt").alias("tgt"), low.alias("start"), high.alias("stop"), (C("r_tgt_start") + low - C("r_start")).alias("tgt_start"), (C("r_tgt_stop") + high - C("r_stop")).alias("tgt_stop"))


@query("SELECT * FROM aln UNION ALL SELECT tgt, abs(CASE WHEN tgt_start >= 0 THEN tgt_start ELSE tgt_stop END), abs(CASE WHEN tgt_start >= 0 THEN tgt_stop ELSE tgt_start END), src, CASE WHEN tgt_start < 0 THEN -stop ELSE start END, CASE WHEN tgt_start < 0 THEN -start ELSE stop END FROM aln")
def jn_bidirectional(s, d):
    return al.bidirectional(v.aln(s, d))


@query("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey) WHERE n = 1")
def jn_map_view_unique(s, d):
    c, o = v.t(s, d, "customer").withColumn("k", C("c_custkey")), v.t(s, d, "orders").withColumn("k", C("o_custkey"))
    return tables.map_view(c, o, "k", "c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey)::INTEGER AS ordinal FROM customer JOIN orders ON c_custkey = o_custkey")
def jn_graph_view(s, d):
    c, o = v.t(s, d, "customer").withColumn("k", C("c_custkey")), v.t(s, d, "orders").withColumn("k", C("o_custkey"))
    return tables.graph_view(c, o, "k", "c_custkey", "o_orderkey")


@query("SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def jn_foreign_key(s, d):
    return tables.foreign_key(v.t(s, d, "region"), v.t(s, d, "nation"), "r_regionkey", "n_regionkey").select("r_name", "n_name")


@query("SELECT c_custkey, n_name FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) LEFT JOIN nation ON k = n_nationkey")
def jn_foreign_key_inverse(s, d):
    c = v.t(s, d, "customer").select("c_custkey", F.nullif(C("c_nationkey"), F.lit(3)).alias("k"))
    return tables.parents_of(c, v.t(s, d, "nation"), "k", "n_nationkey").select("c_custkey", "n_name")


@query("SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b USING (s_nationkey)")
def jn_cluster(s, d):
    return tables.cluster_pairs(v.t(s, d, "supplier"), "s_nationkey", "s_suppkey").select("s_suppkey", "other")


@query("SELECT part, min(id) AS id FROM (SELECT DISTINCT id, upper(unnest(string_split(id, '|'))) AS part FROM (SELECT p_name || '|' || p_brand || '|p' || p_partkey AS id FROM part)) WHERE part <> '' GROUP BY part HAVING count(*) = 1")
def jn_id_rescue(s, d):
    return tables.rescued_ids(v.t(s, d, "part").select(F.concat("p_name", F.lit("|"), "p_brand", F.lit("|p"), C("p_partkey").cast("string")).alias("id")))


@query("SELECT a.id AS l_id, b.id AS r_id FROM iv_events a JOIN iv_events b ON a.seq = b.seq AND a.stop = b.start AND a.id % 2 = b.id % 2")
def jn_adjacent(s, d):
    """Intervals of one strand, here of odd or of even ids, that begin where another ends."""
    return overlap.adjacent(v.iv_events(s, d).withColumn("strand", C("id") % 2), ["seq", "strand"]).select("l_id", "r_id")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn_semi_exists(s, d):
    return tables.existing(v.t(s, d, "customer").select("c_custkey"), "c_custkey", v.t(s, d, "orders"), "o_custkey")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON o_orderkey = l_orderkey AND l_linenumber >= 2 AND l_linenumber <= 2 + o_orderkey % 3")
def jn_range_in_sql(s, d):
    lines = v.t(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return tables.ranged(v.t(s, d, "orders"), lines, "o_orderkey", "l_orderkey", "l_linenumber", F.lit(2), 2 + C("o_orderkey") % 3).select("o_orderkey", "l_linenumber")


@query("SELECT o.id, e.id AS ann_id, greatest(e.start, o.start) - e.start AS ann_start, least(e.stop, o.stop) - e.start AS ann_stop FROM iv_orders o JOIN iv_events e ON o.seq = e.seq AND o.start < e.stop AND e.start < o.stop")
def jn_annotation(s, d):
    """The part of each annotation that an interval overlaps, in the annotation's own coordinates."""
    x = overlap.clipped(overlap.overlap_join(v.iv_orders(s, d), v.iv_events(s, d)))
    return x.select(C("l_id").alias("id"), C("r_id").alias("ann_id"), (C("clip_start") - C("r_start")).alias("ann_start"), (C("clip_stop") - C("r_start")).alias("ann_stop"))


# --- alignments


@query("SELECT src, count(DISTINCT (tgt, tgt_start < 0)) AS n FROM aln GROUP BY src")
def ag_distinct_targets(s, d):
    return al.target_count(v.aln(s, d))


_ORDERED = "FROM (SELECT *, row_number() OVER w AS up, row_number() OVER z AS down, count(*) OVER (PARTITION BY src, tgt) AS n FROM aln WINDOW w AS (PARTITION BY src, tgt ORDER BY start, stop DESC, tgt_start, tgt_stop), z AS (PARTITION BY src, tgt ORDER BY start DESC, stop, tgt_start DESC, tgt_stop DESC))"


@query(f"SELECT src, tgt, max(CASE WHEN up = 1 THEN start END) AS start, max(CASE WHEN down = 1 THEN stop END) AS stop, max(CASE WHEN up = 1 THEN tgt_start END) AS tgt_start, max(CASE WHEN down = 1 THEN tgt_stop END) AS tgt_stop, max(n) AS n {_ORDERED} GROUP BY src, tgt")
def ag_merge_all(s, d):
    return al.merged_all(v.aln(s, d))


def _merge_sql(gap: int, most: int, least: int) -> str:
    w = "PARTITION BY src, tgt ORDER BY start, stop DESC, tgt_start, tgt_stop"
    cut = f"CASE WHEN start - lag(stop) OVER w > {gap} OR tgt_start - lag(tgt_stop) OVER w > {most} OR tgt_start - lag(tgt_stop) OVER w < {least} OR lag(stop) OVER w IS NULL THEN 1 ELSE 0 END AS cut"
    return f"SELECT src, tgt, arg_min(start, k) AS start, arg_max(stop, k) AS stop, arg_min(tgt_start, k) AS tgt_start, arg_max(tgt_stop, k) AS tgt_stop, count(*) AS n FROM (SELECT *, sum(cut) OVER w AS run, row_number() OVER w AS k FROM (SELECT *, {cut} FROM aln WINDOW w AS ({w})) WINDOW w AS ({w})) GROUP BY src, tgt, run"


@query(_merge_sql(400, 400, -400))
def ag_merge_gap(s, d):
    return al.merged(v.aln(s, d), 400, 400, -400)


_FLAT = "SELECT seq, kind, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY seq, kind ORDER BY start, stop, new ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY seq, kind ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (SELECT seq, id % 7 AS kind, start, stop FROM iv_events))) GROUP BY seq, kind, island"


def _depth_sql(least: str) -> str:
    return f"SELECT seq, start, stop, depth FROM (SELECT seq, pos AS start, lead(pos) OVER (PARTITION BY seq ORDER BY pos) AS stop, (sum(dd) OVER (PARTITION BY seq ORDER BY pos))::BIGINT AS depth FROM (SELECT seq, pos, sum(dd) AS dd FROM (SELECT seq, start AS pos, 1 AS dd FROM flat UNION ALL SELECT seq, stop, -1 FROM flat) GROUP BY seq, pos)) WHERE depth >= {least} AND stop IS NOT NULL"


_S_FLAT = lambda least: "WITH iv_events AS (" + v.SQL["iv_events"] + f"), flat AS ({_FLAT}) " + _depth_sql(least)


def ag_depth_regions(s, d):
    """Stretches where two kinds of a user's events at least are open."""
    return al.depth_regions(v.iv_events(s, d).withColumn("kind", C("id") % 7), "seq", "kind", 2)


def ag_depth_fraction(s, d):
    """The same for a quarter of the seven kinds."""
    return al.depth_regions(v.iv_events(s, d).withColumn("kind", C("id") % 7), "seq", "kind", F.lit(0.25) * 7)


for _f, _least in ((ag_depth_regions, "2"), (ag_depth_fraction, "1.75")):
    register(_f, _S_FLAT(_least))


# --- tables


@query("SELECT count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def ra_count(s, d):
    return v.t(s, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT DISTINCT s_nationkey FROM supplier")
def ra_distinct_keys(s, d):
    return v.t(s, d, "supplier").select("s_nationkey").distinct()


@query("SELECT l_partkey, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY l_partkey")
def ra_group_minmax(s, d):
    return v.t(s, d, "lineitem").groupBy("l_partkey").agg(F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def ra_page(s, d):
    return tables.page(v.t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 50)


@query("SELECT c_custkey, n FROM (SELECT o_custkey AS c_custkey, o_orderkey AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3")
def ra_top_hits(s, d):
    return tables.top(v.t(s, d, "orders").select(C("o_custkey").alias("c_custkey"), C("o_orderkey").alias("n")), "c_custkey", "n", 3)


@query("SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k, c_mktsegment FROM customer) WHERE k IS NULL AND c_mktsegment = 'BUILDING'")
def tb_query_null(s, d):
    c = v.t(s, d, "customer").select("c_custkey", F.nullif(C("c_nationkey"), F.lit(3)).alias("k"), "c_mktsegment")
    return tables.query(c, k=None, c_mktsegment="BUILDING").select("c_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_nationkey % 2 = 0")
def tb_upsert(s, d):
    n = v.t(s, d, "nation").select("n_nationkey", "n_name")
    return tables.upsert(n, n.where("n_nationkey % 2 = 0").withColumn("n_name", F.lower("n_name")), "n_nationkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN 'x' ELSE c_name END AS c_name FROM customer WHERE c_nationkey <> 5")
def tb_update_delete(s, d):
    c = tables.delete(v.t(s, d, "customer"), C("c_nationkey") == 5)
    return tables.update(c, C("c_nationkey") == 4, c_name="x").select("c_custkey", "c_name")


@query("SELECT p_partkey, upper(p_brand) || '/' || p_size AS label FROM part")
def tb_alias(s, d):
    return tables.aliased(v.t(s, d, "part"), label="concat(upper(p_brand), '/', p_size)").select("p_partkey", "label")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def tb_last_wins(s, d):
    return last_wins(v.t(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


# --- graphs


def _sp(s: SparkSession, d: str) -> Graph:
    e = v.g_sp(s, d)
    return Graph.of(e.withColumn("dst", C("dst") + 1_000_000), "edge")


@query("SELECT src AS id FROM g_sp UNION SELECT dst + 1000000 FROM g_sp")
def gr_nodes(s, d):
    return _sp(s, d).nodes


@query("SELECT dst + 1000000 AS src, src AS dst, edge FROM g_sp")
def gr_inverse(s, d):
    return _sp(s, d).inverse().edges


@query("SELECT src, dst, edge + 100 AS edge FROM g_ring WHERE src < 10 UNION ALL SELECT src, dst, edge FROM g_ring WHERE src >= 10")
def gr_merge(s, d):
    g = Graph.of(v.g_ring(s, d), "edge")
    other = Graph.of(g.edges.where("src < 10").withColumn("edge", C("edge") + 100), "edge")
    return g.merged(other).edges.select("src", "dst", "edge")


@query("SELECT src, dst, edge FROM g_ring WHERE src % 5 <> 0")
def gr_delete_node(s, d):
    g = Graph.of(v.g_ring(s, d), "edge")
    return g.without_nodes(g.nodes.where("id % 5 = 0")).edges


@query("SELECT 'edge' AS what, src::VARCHAR AS a, dst::VARCHAR AS b FROM g_ring WHERE src = 3")
def gr_difference(s, d):
    g = Graph.of(v.g_ring(s, d), "edge")
    return g.difference(g.without_edges(g.edges.where("src = 3")))


_EXONS = "(SELECT o_custkey % 200 AS cluster, o_orderkey AS exon, o_orderkey % 40 * 10 AS start, o_orderkey % 40 * 10 + 5 AS stop FROM orders)"


def _exons(s: SparkSession, d: str) -> DataFrame:
    at = C("o_orderkey") % 40 * 10
    return v.t(s, d, "orders").select((C("o_custkey") % 200).alias("cluster"), C("o_orderkey").alias("exon"), at.alias("start"), (at + 5).alias("stop"))


@query(f"SELECT a.exon AS src, b.exon AS dst FROM {_EXONS} a JOIN {_EXONS} b ON a.cluster = b.cluster AND a.start = b.start AND a.exon <> b.exon")
def gr_splice_alt5(s, d):
    e = _exons(s, d)
    return splice_graph(e, e.select("cluster", C("exon").alias("splice"), "start", "stop"))[1]


@query(f"SELECT a.exon AS src, b.exon AS dst, s.exon AS edge FROM {_EXONS} a JOIN {_EXONS} s ON a.cluster = s.cluster AND a.stop = s.start + 5 JOIN {_EXONS} b ON b.cluster = s.cluster AND b.start = s.start + 20")
def gr_splice_next(s, d):
    e = _exons(s, d)
    splices = e.select("cluster", C("exon").alias("splice"), C("stop").alias("start"), (C("start") + 20).alias("stop"))
    return splice_graph(e, splices)[0]


# --- patterns


def _ng(s: SparkSession, d: str) -> Graph:
    return Graph.of(v.g_ring(s, d), "edge")


@query("SELECT a.src AS n_0, a.dst AS n_1, b.dst AS n_2, a.edge AS e_0_1, b.edge AS e_1_2 FROM g_ring a JOIN g_ring b ON a.dst = b.src WHERE a.src <> a.dst AND b.dst <> a.src AND b.dst <> a.dst")
def gq_path(s, d):
    return pattern.match(_ng(s, d), {0: {1: None}, 1: {2: None}, 2: {}})


@query("SELECT a.src AS n_0, a.dst AS n_1, b.dst AS n_2 FROM g_ring a JOIN g_ring b ON a.dst = b.src JOIN g_ring c ON c.src = a.src AND c.dst = b.dst WHERE a.src <> a.dst AND b.dst <> a.src AND b.dst <> a.dst")
def gq_triangle_closure(s, d):
    return pattern.match(_ng(s, d), {0: {1: None, 2: None}, 1: {2: None}, 2: {}}, edges=False)


@query("SELECT a.src AS n_0, a.dst AS n_1, b.dst AS n_2 FROM g_sp a JOIN g_sp b ON a.src = b.src AND a.dst <> b.dst WHERE a.edge > 1 AND b.edge > 3")
def gq_fork_injective(s, d):
    g = Graph.of(v.g_sp(s, d).withColumn("dst", C("dst") + 1_000_000), "edge")
    out = pattern.match(g, {0: {1: {"filter": lambda to, at, edge, bound: edge > 1}, 2: {"filter": lambda to, at, edge, bound: edge > 3}}, 1: {}, 2: {}}, edges=False)
    return out.select("n_0", (C("n_1") - 1_000_000).alias("n_1"), (C("n_2") - 1_000_000).alias("n_2"))


@query("SELECT a.src AS n_0, a.dst AS n_1 FROM g_ring a WHERE a.src <> a.dst AND a.dst % 3 = 1 AND a.edge < 7")
def gq_filter(s, d):
    return pattern.match(_ng(s, d), {0: {1: {"filter": lambda to, at, edge, bound: (to % 3 == 1) & (edge < 7)}}, 1: {}}, edges=False)


@query("SELECT r.src AS n_0, r.dst AS n_1, b.src AS n_2 FROM g_ring r JOIN g_ring b ON b.dst = r.dst WHERE r.src <> r.dst AND b.src <> r.src AND b.src <> r.dst")
def gq_two_graphs(s, d):
    g = _ng(s, d)
    return pattern.match(g, {0: {1: None}, 1: {2: {"graph": g.inverse()}}, 2: {}}, edges=False)


@query("SELECT a.src AS n_0, a.dst AS n_1, b.dst AS n_2 FROM g_ring a JOIN g_ring b ON a.dst = b.src JOIN g_ring c ON c.src = b.dst AND c.dst = a.src WHERE a.src <> a.dst AND b.dst <> a.src AND b.dst <> a.dst")
def gq_headless_cycle(s, d):
    return pattern.match(_ng(s, d), {0: {1: None}, 1: {2: None}, 2: {0: None}}, edges=False)


@query("SELECT a.src AS n_0, a.dst AS n_1, b.dst AS n_2 FROM g_ring a JOIN g_ring b ON a.dst = b.src WHERE a.src <> a.dst AND b.dst <> a.src AND b.dst <> a.dst AND b.edge = 3 UNION ALL SELECT a.src, a.dst, b.dst FROM g_ring a JOIN g_ring b ON a.dst = b.src WHERE a.src <> a.dst AND b.dst <> a.src AND b.dst <> a.dst AND b.edge <= 5")
def gq_subqueries_or(s, d):
    only = lambda ok: {1: {2: {"filter": lambda to, at, edge, bound: ok(edge)}}, 2: {}}
    return pattern.match(_ng(s, d), {0: {1: {"subqueries": [only(lambda e: e == 3), only(lambda e: e <= 5)]}}, 1: {}}, edges=False)


@query("SELECT src AS n_0, dst AS n_1 FROM g_ring WHERE src <> dst AND src IN (1, 2, 3)")
def gq_seed(s, d):
    seed = s.range(1, 4).select(C("id").alias("n_0"))
    return pattern.match(_ng(s, d), {0: {1: None}, 1: {}}, seed=seed, edges=False)


@query("SELECT o.id AS n_0, e.id + 10000000 AS n_1, greatest(o.start, e.start) AS low, least(o.stop, e.stop) AS high, 20000000 + e.id % 5 AS n_2 FROM iv_orders o JOIN iv_events e ON o.seq = e.seq AND o.start < e.stop AND e.start < o.stop")
def gq_alignment_edge(s, d):
    """A pattern that goes through an overlap: from an interval to what overlaps it, and on to what that is of."""
    o, e = v.iv_orders(s, d), v.iv_events(s, d).withColumn("id", C("id") + 10_000_000)
    kinds = Graph.of(e.select(C("id").alias("src"), (20_000_000 + C("id") % 5).alias("dst")))
    step = pattern.through_overlap(o, e)
    seed = o.select(C("id").alias("n_0"))
    out = pattern.match(kinds, {0: {1: {"expand": step}}, 1: {2: None}, 2: {}}, seed=seed)
    return out.select("n_0", "n_1", C("e_0_1.start").alias("low"), C("e_0_1.stop").alias("high"), "n_2")


# --- unions and annotations


@query("SELECT 'c.' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's.' || s_suppkey, s_name FROM supplier")
def so_prefix_union(s, d):
    c = v.t(s, d, "customer").select(C("c_custkey").cast("string").alias("id"), C("c_name").alias("name"))
    return tables.prefix_union({"c": c, "s": v.t(s, d, "supplier").select(C("s_suppkey").cast("string").alias("id"), C("s_name").alias("name"))}, "id")


@query("SELECT id, split_part(id, '.', 1) AS prefix, substr(id, strpos(id, '.') + 1) AS rest FROM (SELECT 'a' || p_size || '.' || p_partkey || '.x' AS id FROM part)")
def so_prefix_split(s, d):
    p = v.t(s, d, "part").select(F.concat(F.lit("a"), C("p_size").cast("string"), F.lit("."), C("p_partkey").cast("string"), F.lit(".x")).alias("id"))
    a, b = tables.split_prefix(C("id"))
    return p.select("id", a.alias("prefix"), b.alias("rest"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN start ELSE -stop END AS start, CASE WHEN id % 2 = 0 THEN stop ELSE -start END AS stop, CASE WHEN id % 2 = 0 THEN start % 3 + 1 ELSE -((((-stop + 1) % 3) + 3) % 3 + 1) END AS frame FROM iv_events")
def an_orientation(s, d):
    """Annotations given with a strand, as signed intervals with their reading frame."""
    x = iv.oriented(C("start"), C("stop"), F.when(C("id") % 2 == 0, 1).otherwise(-1))
    return v.iv_events(s, d).select("id", x.alias("x")).select("id", "x.*", iv.frame(C("x.start")).alias("frame"))
