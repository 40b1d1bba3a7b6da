"""Queries of the alignment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import alignment as al
from strandloom.plans import views as v
from strandloom.plans.base import query

C = F.col
_LINE = "PARTITION BY src, tgt ORDER BY start, stop DESC, tgt_start, tgt_stop"


@query("SELECT src, tgt, minus, a.tgt_start AS tgt_start, z.tgt_stop AS tgt_stop, least(a.start, z.start) AS start, greatest(a.stop, z.stop) AS stop FROM (SELECT src, tgt, tgt_start < 0 AS minus, min({'tgt_start': tgt_start, 'tgt_stop': tgt_stop, 'start': start, 'stop': stop}) AS a, max({'tgt_stop': tgt_stop, 'tgt_start': tgt_start, 'start': start, 'stop': stop}) AS z FROM aln GROUP BY ALL)")
def ag_cover_by_target(s, d):
    return al.covers(v.aln(s, d))


def _merge_sql(gap: int, most: int, least: int, view: str = "aln") -> str:
    cut = f"CASE WHEN start - lag(stop) OVER w > {gap} OR tgt_start - lag(tgt_stop) OVER w > {most} OR tgt_start - lag(tgt_stop) OVER w < {least} OR lag(stop) OVER w IS NULL THEN 1 ELSE 0 END AS cut"
    return f"SELECT *, sum(cut) OVER w AS run, row_number() OVER w AS k FROM (SELECT *, {cut} FROM {view} WINDOW w AS ({_LINE})) WINDOW w AS ({_LINE})"


_ENDS = "arg_min(start, k) AS start, arg_max(stop, k) AS stop, arg_min(tgt_start, k) AS tgt_start, arg_max(tgt_stop, k) AS tgt_stop, count(*) AS n"


@query(f"SELECT src, tgt, {_ENDS} FROM ({_merge_sql(10000, 10000, -10)}) GROUP BY src, tgt, run")
def ag_merge_most(s, d):
    """No sequence here is as long as the preset's limit of 50,000; :func:`ag_merge_sized` has one that cuts."""
    return al.merged_most(v.aln(s, d))


@query(f"WITH RECURSIVE o AS ({_merge_sql(400, 400, -400)}), r AS (SELECT *, start AS f0, tgt_start AS f1, 1 AS piece FROM o WHERE k = 1 UNION ALL SELECT o.*, CASE WHEN o.cut = 1 OR o.stop - r.f0 > 300 OR o.tgt_stop - r.f1 > 300 THEN o.start ELSE r.f0 END, CASE WHEN o.cut = 1 OR o.stop - r.f0 > 300 OR o.tgt_stop - r.f1 > 300 THEN o.tgt_start ELSE r.f1 END, CASE WHEN o.cut = 1 OR o.stop - r.f0 > 300 OR o.tgt_stop - r.f1 > 300 THEN r.piece + 1 ELSE r.piece END FROM r JOIN o ON o.src = r.src AND o.tgt = r.tgt AND o.k = r.k + 1) SELECT src, tgt, {_ENDS} FROM r GROUP BY src, tgt, piece")
def ag_merge_sized(s, d):
    return al.merged(v.aln(s, d), 400, 400, -400, 300)


@query(f"SELECT src, tgt, run_start, start, stop, tgt_start, tgt_stop FROM (SELECT *, min(start) OVER (PARTITION BY src, tgt, run) AS run_start, count(*) OVER (PARTITION BY src, tgt, run) AS blocks FROM (SELECT src, tgt, run, arg_min(start, k) AS start, arg_max(stop, k) AS stop, arg_min(tgt_start, k) AS tgt_start, arg_max(tgt_stop, k) AS tgt_stop FROM (SELECT *, sum(new) OVER (PARTITION BY src, tgt, run ORDER BY k) AS block FROM (SELECT *, CASE WHEN lag(stop) OVER w = start AND lag(tgt_stop) OVER w = tgt_start THEN 0 ELSE 1 END AS new FROM ({_merge_sql(15, 60, 0, 'steps')}) WINDOW w AS (PARTITION BY src, tgt, run ORDER BY k))) GROUP BY src, tgt, run, block)) WHERE blocks > 1")
def ag_merge_blocks(s, d):
    """The one-to-one blocks of each run, those that touch as one."""
    runs = al.merged(v.steps(s, d), 15, 60, 0, blocks=True)
    return runs.select("src", "tgt", C("start").alias("run_start"), F.explode("blocks").alias("b")).select("src", "tgt", "run_start", "b.*")


_CLIP = "greatest(start, lo) AS start, least(stop, hi) AS stop, tgt_start + greatest(start, lo) - start AS tgt_start, tgt_stop + least(stop, hi) - stop AS tgt_stop"


@query(f"SELECT src, tgt, run_start, a AS start, z AS stop, tgt_start + a - start AS tgt_start, tgt_stop + z - stop AS tgt_stop FROM (SELECT *, greatest(start, run_start + 12) AS a, least(stop, run_start + 48) AS z, count(*) OVER (PARTITION BY src, tgt, run_start) AS n FROM (SELECT *, min(start) OVER (PARTITION BY src, tgt, run) AS run_start FROM (SELECT src, tgt, run, arg_min(start, k) AS start, arg_max(stop, k) AS stop, arg_min(tgt_start, k) AS tgt_start, arg_max(tgt_stop, k) AS tgt_stop FROM (SELECT *, sum(new) OVER (PARTITION BY src, tgt, run ORDER BY k) AS block FROM (SELECT *, CASE WHEN lag(stop) OVER w = start AND lag(tgt_stop) OVER w = tgt_start THEN 0 ELSE 1 END AS new FROM ({_merge_sql(15, 60, 0, 'steps')}) WINDOW w AS (PARTITION BY src, tgt, run ORDER BY k))) GROUP BY src, tgt, run, block)) WHERE start < run_start + 48 AND stop > run_start + 12) WHERE n > 1")
def ag_clip_blocks(s, d):
    """The blocks of each run from its 12th to its 48th letter; runs of which fewer than two are left have none."""
    runs = al.merged(v.steps(s, d), 15, 60, 0, blocks=True)
    cut = al.clip_blocks(C("blocks"), C("start") + 12, C("start") + 48)
    return runs.select("src", "tgt", C("start").alias("run_start"), F.explode(cut).alias("b")).select("src", "tgt", "run_start", "b.*")


def _regions_sql(view: str, keys: str, member: str, least: str) -> str:
    """CTEs up to ``regions``: what ``least`` members at least are open throughout."""
    line = f"PARTITION BY {keys}, {member} ORDER BY start, stop"
    return (
        f"isle AS (SELECT {keys}, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(new) OVER ({line}, new DESC ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start < max(stop) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {view})) GROUP BY {keys}, {member}, island), "
        f"points AS (SELECT {keys}, pos, sum(up) AS up, sum(up) - sum(down) AS d FROM (SELECT {keys}, start AS pos, 1 AS up, 0 AS down FROM isle UNION ALL SELECT {keys}, stop, 0, 1 FROM isle) GROUP BY ALL), "
        f"deep AS (SELECT *, lead(pos) OVER (PARTITION BY {keys} ORDER BY pos) AS nxt, sum(d) OVER (PARTITION BY {keys} ORDER BY pos) AS depth FROM points), "
        f"held AS (SELECT *, CASE WHEN lag(nxt) OVER (PARTITION BY {keys} ORDER BY pos) = pos AND depth - up >= {least} THEN 0 ELSE 1 END AS new FROM deep WHERE depth >= {least} AND nxt IS NOT NULL), "
        f"regions AS (SELECT {keys}, min(pos) AS start, max(nxt) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY pos) AS chain FROM held) GROUP BY {keys}, chain)"
    )


@query(f"WITH {_regions_sql('aln', 'src', 'tgt', '3')} SELECT * FROM regions")
def ag_source_regions(s, d):
    """Where three targets at least are aligned: the regions of the sources alone."""
    return al.grouped_by_sequences(v.aln(s, d), least=3, source_only=True)


@query(f"WITH {_regions_sql('aln', 'src', 'tgt', '3')} SELECT a.src, greatest(a.start, r.start) AS start, least(a.stop, r.stop) AS stop, tgt, tgt_start + greatest(a.start, r.start) - a.start AS tgt_start, tgt_stop + least(a.stop, r.stop) - a.stop AS tgt_stop FROM aln a JOIN regions r ON a.src = r.src AND a.start < r.stop AND r.start < a.stop")
def ag_vertical_group(s, d):
    """The same, as the aligned intervals cut to them."""
    return al.grouped_by_sequences(v.aln(s, d), least=3)


@query(f"WITH marked AS (SELECT *, tgt % 3 AS grp FROM aln), {_regions_sql('marked', 'src, grp', 'tgt', '2')} SELECT a.src, a.grp, greatest(a.start, r.start) AS start, least(a.stop, r.stop) AS stop, tgt, tgt_start + greatest(a.start, r.start) - a.start AS tgt_start, tgt_stop + least(a.stop, r.stop) - a.stop AS tgt_stop FROM marked a JOIN regions r ON a.src = r.src AND a.grp = r.grp AND a.start < r.stop AND r.start < a.stop WHERE a.grp < 2")
def ag_group_lists(s, d):
    """Two groups of targets, each by itself; the third is left out."""
    groups = v.t(s, d, "part").select(C("p_partkey").alias("tgt"), (C("p_partkey") % 3).alias("grp")).where("grp < 2")
    return al.grouped_by_sequences(v.aln(s, d), least=2, groups=groups)


_SHARED = "(SELECT grp, ceil(count(*) * 0.002)::INTEGER AS least FROM (SELECT p_partkey % 3 AS grp FROM part) GROUP BY grp)"


@query(f"WITH marked AS (SELECT a.*, grp, least FROM (SELECT *, tgt % 3 AS grp FROM aln) a JOIN {_SHARED} USING (grp)), {_regions_sql('marked', 'src, grp, least', 'tgt', 'least')} SELECT src, grp, start, stop FROM regions")
def ag_group_share(s, d):
    """Three groups of targets: where a five-hundredth of a group's are aligned."""
    groups = v.t(s, d, "part").select(C("p_partkey").alias("tgt"), (C("p_partkey") % 3).alias("grp"))
    return al.grouped_by_sequences(v.aln(s, d), share=0.002, groups=groups, source_only=True)


@query(f"WITH runs AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY start) > 1 AS later FROM (SELECT src, tgt, {_ENDS} FROM ({_merge_sql(5, 5, -5)}) GROUP BY src, tgt, run)), {_regions_sql('runs', 'src', 'tgt', '2')}, cuts AS (SELECT r.src, r.start AS b, r.stop AS e, m.pos FROM regions r JOIN (SELECT DISTINCT src, unnest([start, stop]) AS pos FROM runs WHERE later) m ON m.src = r.src AND m.pos > r.start AND m.pos < r.stop UNION ALL SELECT src, start, stop, start FROM regions) SELECT src, pos AS start, coalesce(lead(pos) OVER (PARTITION BY src, b ORDER BY pos), e) AS stop FROM cuts")
def ag_split(s, d):
    """Regions cut where a target's later runs begin or end."""
    return al.split_regions(v.aln(s, d), 5, 5, -5, least=2)


@query(f"WITH swapped AS (SELECT tgt AS src, CASE WHEN tgt_start >= 0 THEN tgt_start ELSE -tgt_stop END AS start, CASE WHEN tgt_start >= 0 THEN tgt_stop ELSE -tgt_start END AS stop, src AS tgt FROM aln), {_regions_sql('swapped', 'src', 'tgt', '2')} SELECT * FROM regions")
def ag_axis_regions(s, d):
    """The regions of the axis that two sources at least are aligned to."""
    a = v.aln(s, d)
    low, high = F.when(C("tgt_start") >= 0, C("tgt_start")).otherwise(-C("tgt_stop")), F.when(C("tgt_start") >= 0, C("tgt_stop")).otherwise(-C("tgt_start"))
    axis = a.select(C("tgt").alias("src"), low.alias("start"), high.alias("stop"), C("src").alias("tgt"), C("start").alias("tgt_start"), C("stop").alias("tgt_stop"))
    return al.grouped_by_sequences(axis, least=2, source_only=True)


@query("SELECT src, start + lo - tgt_start AS start, stop + hi - tgt_stop AS stop, tgt, lo AS tgt_start, hi AS tgt_stop FROM (SELECT a.*, greatest(tgt_start, low) AS lo, least(tgt_stop, high) AS hi FROM aln a JOIN (SELECT p_partkey AS tgt, p_size * 10 AS low, p_size * 10 + 300 AS high FROM part WHERE p_size > 20) USING (tgt) WHERE tgt_start >= 0) WHERE lo < hi")
def ag_mask(s, d):
    """Targets cut to one mask each, all forward; targets without a mask are left out."""
    masks = v.t(s, d, "part").where("p_size > 20").select(C("p_partkey").alias("tgt"), (C("p_size") * 10).cast("long").alias("low"), (C("p_size") * 10 + 300).cast("long").alias("high"))
    return al.masked(v.aln(s, d), masks)


@query("SELECT * FROM aln WHERE stop - start BETWEEN 5 AND 12")
def ag_size_filter(s, d):
    return al.sized(v.aln(s, d), 5, 12)


_SAME = "list_sum(list_transform(range(1, 21), lambda i: CASE WHEN substr(src_seq, i, 1) = substr(tgt_seq, i, 1) THEN 1 ELSE 0 END))"
_WHOLE = "greatest(max(stop) - min(start), max(tgt_stop) - min(tgt_start))"


@query(f"SELECT src, tgt, sum({_SAME})::BIGINT AS same, {_WHOLE} AS length, sum({_SAME})::BIGINT / {_WHOLE} AS share FROM hits GROUP BY src, tgt")
def ag_identity(s, d):
    return al.identity(v.hits(s, d))


@query(f"SELECT src, tgt, sum(tgt_stop - tgt_start)::BIGINT AS aligned, {_WHOLE} AS length, sum(tgt_stop - tgt_start)::BIGINT / {_WHOLE} AS share FROM blocks GROUP BY src, tgt")
def ag_fraction_aligned(s, d):
    return al.aligned(v.blocks(s, d))


@query("SELECT src, tgt, greatest(stop - start, tgt_stop - tgt_start) AS longer, least(stop - start, tgt_stop - tgt_start) AS shorter FROM (SELECT src, tgt, min(start) AS start, max(stop) AS stop, min(tgt_start) AS tgt_start, max(tgt_stop) AS tgt_stop FROM blocks GROUP BY src, tgt)")
def ag_edge_length(s, d):
    b = v.blocks(s, d).groupBy("src", "tgt").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("tgt_start").alias("tgt_start"), F.max("tgt_stop").alias("tgt_stop"))
    x = [C(c) for c in ("start", "stop", "tgt_start", "tgt_stop")]
    return b.select("src", "tgt", al.edge_length(*x).alias("longer"), al.edge_length(*x, F.least).alias("shorter"))


_BEST = """WITH letter AS (SELECT src, tgt, start + i AS a, tgt_start + i AS b, substr(src_seq, i + 1, 1) = substr(tgt_seq, i + 1, 1) AS ok, row_number() OVER (PARTITION BY src ORDER BY start, tgt_start, i) AS k FROM (SELECT *, unnest(range(0, 20)) AS i FROM hits)),
marked AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY src ORDER BY k) AS wrong, CASE WHEN ok AND NOT (coalesce(lag(ok) OVER w, false) AND lag(a) OVER w = a - 1 AND lag(b) OVER w = b - 1) THEN 1 ELSE 0 END AS new FROM letter WINDOW w AS (PARTITION BY src ORDER BY k)),
seg AS (SELECT src, tgt, run, min(a) AS a, min(b) AS b, count(*) AS size, min(wrong) AS wrong FROM (SELECT *, sum(new) OVER (PARTITION BY src ORDER BY k) AS run FROM marked) WHERE ok GROUP BY src, tgt, run),
summed AS (SELECT *, sum(size) OVER (PARTITION BY src ORDER BY run) AS whole FROM seg),
tried AS (SELECT x.src, x.tgt, x.run AS i, y.run AS j, y.a AS start, x.a + x.size AS stop, y.b AS tgt_start, x.b + x.size AS tgt_stop, x.whole - y.whole + y.size AS same, x.whole - y.whole + y.size + x.wrong - y.wrong AS score FROM summed x JOIN summed y ON x.src = y.src AND y.run <= x.run)
SELECT src, tgt, start, stop, tgt_start, tgt_stop FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, i, j DESC) AS k FROM tried WHERE same >= 0.6 * greatest(stop - start, tgt_stop - tgt_start) - 1e-12) WHERE k = 1"""


@query(_BEST)
def ag_conserved(s, d):
    """The best stretch of each edge at an identity of 0.6 or more."""
    return al.conserved(v.hits(s, d), 0.6)


@query("SELECT src, tgt, CASE WHEN start > ls THEN ls END AS gap_start, CASE WHEN start > ls THEN start END AS gap_stop, CASE WHEN tgt_start > lt THEN lt END AS insert_start, CASE WHEN tgt_start > lt THEN tgt_start END AS insert_stop FROM (SELECT *, lag(stop) OVER w AS ls, lag(tgt_stop) OVER w AS lt FROM aln WINDOW w AS (PARTITION BY src, tgt ORDER BY start, stop, tgt_start, tgt_stop)) WHERE start > ls OR tgt_start > lt")
def ag_gaps(s, d):
    return al.gap_rows(v.aln(s, d))


@query("SELECT src, start + i AS pos, substr(src_seq, i + 1, 1) AS letter, tgt, tgt_start + i AS tgt_pos, substr(tgt_seq, i + 1, 1) AS tgt_letter FROM (SELECT *, unnest(range(0, 20)) AS i FROM hits)")
def ag_column_letters(s, d):
    return al.column_letters(v.hits(s, d))


@query(f"SELECT src, tgt, {_ENDS} FROM ({_merge_sql(0, 0, 0, 'steps')}) GROUP BY src, tgt, run")
def ag_edges(s, d):
    """The edges of every source by the default rules: no gap, no insert; then where one target at least is aligned, which is everywhere."""
    return al.merged(v.steps(s, d), 0, 0, 0)


@query("SELECT src, start, stop, tgt, tgt_start, tgt_stop FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY start DESC, stop, tgt_start DESC, tgt_stop DESC) AS k FROM aln) WHERE k = 1")
def ag_custom_method(s, d):
    """A method of one's own: of each source and target the last interval."""
    return al.with_method(v.aln(s, d), lambda rows: rows.sort_values(["start", "stop", "tgt_start", "tgt_stop"], ascending=[False, True, False, False]).drop_duplicates("tgt"), ("src",))


@query("SELECT * FROM aln WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def ag_known_sources(s, d):
    """Rows of known sequences; the strict form, which all of these pass, makes an unknown one an error."""
    known = v.t(s, d, "supplier").where("s_nationkey < 5").select(C("s_suppkey").alias("id"))
    return al.known_only(al.known_only(v.aln(s, d), known, strict=False), known)


@query("SELECT * FROM aln UNION ALL SELECT tgt, CASE WHEN tgt_start < 0 THEN -tgt_stop ELSE tgt_start END, CASE WHEN tgt_start < 0 THEN -tgt_start ELSE tgt_stop END, src, CASE WHEN tgt_start < 0 THEN -stop ELSE start END, CASE WHEN tgt_start < 0 THEN -start ELSE stop END FROM aln WHERE src % 4 <> tgt % 4")
def jn_bidirectional_pruned(s, d):
    """Back and forth, but for pairs of one genome, here the ids' remainder."""
    return al.bidirectional(v.aln(s, d), lambda i: i % 4)
