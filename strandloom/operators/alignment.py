"""Grouping of aligned intervals: covers, merging by gap rules, depth sweeps, blocks.

An alignment is a table (src, start, stop, tgt, tgt_start, tgt_stop); a reverse target
has negative coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandloom.functions import intervals as iv
from strandloom.functions import sequences as sq
from strandloom.operators.overlap import overlap_join


def bidirectional(aln: DataFrame, genome: Callable[[Column], Column] | None = None) -> DataFrame:
    """The alignment with every row also from target to source, turned so that its source is forward.

    With ``genome``, a function of an id column, rows within one genome stay one-way.
    """
    turned = iv.oriented(F.col("tgt_start"), F.col("tgt_stop"), F.lit(0)), F.col("tgt_start") < 0
    turn = aln if genome is None else aln.where(~genome(F.col("src")).eqNullSafe(genome(F.col("tgt"))))
    back = turn.select(
        F.col("tgt").alias("src"), turned[0]["start"].alias("start"), turned[0]["stop"].alias("stop"), F.col("src").alias("tgt"),
        F.when(turned[1], -F.col("stop")).otherwise(F.col("start")).alias("tgt_start"), F.when(turned[1], -F.col("start")).otherwise(F.col("stop")).alias("tgt_stop"),
    )
    return aln.select(back.columns).union(back)


def target_count(aln: DataFrame) -> DataFrame:
    """(src, n): how many targets, by strand, each source is aligned to."""
    return aln.groupBy("src").agg(F.countDistinct("tgt", F.col("tgt_start") < 0).alias("n"))


def two_hop(aln: DataFrame, axis: DataFrame) -> DataFrame:
    """(src, tgt, start, tgt_start, size): sources over the stretches of the axis that they share.

    Both have rows (src, start, axis, low, high), where low and high are signed; one strand
    of the axis meets the other not.  An interval does not meet itself.
    """
    x = overlap_join(aln, axis, "axis", "low", "high").where((F.col("l_low") >= 0) == (F.col("r_low") >= 0))
    low, high = F.greatest("l_low", "r_low"), F.least("l_high", "r_high")
    x = x.select(F.col("l_src").alias("src"), F.col("r_src").alias("tgt"), (F.col("l_start") + low - F.col("l_low")).alias("start"), (F.col("r_start") + low - F.col("r_low")).alias("tgt_start"), (high - low).alias("size"))
    return x.where("not (src = tgt and start = tgt_start)")


def covers(aln: DataFrame) -> DataFrame:
    """One row for each source, target and strand: the covering target interval, and the source at its ends."""
    first, last = F.struct("tgt_start", "tgt_stop", "start", "stop"), F.struct("tgt_stop", "tgt_start", "start", "stop")
    out = aln.groupBy("src", "tgt", (F.col("tgt_start") < 0).alias("minus")).agg(F.min("tgt_start").alias("tgt_start"), F.max("tgt_stop").alias("tgt_stop"), F.min(first).alias("a"), F.max(last).alias("b"))
    return out.select("src", "tgt", "minus", "tgt_start", "tgt_stop", F.least("a.start", "b.start").alias("start"), F.greatest("a.stop", "b.stop").alias("stop"))


def _order() -> list:
    return ["start", F.desc("stop"), "tgt_start", "tgt_stop"]


def merged(aln: DataFrame, max_gap: int, max_insert: int, min_insert: int, max_size: int | None = None, keys: tuple[str, ...] = ("src", "tgt"), blocks: bool = False) -> DataFrame:
    """Runs of intervals of a source and target, by source order, that neither gap nor insert parts.

    The gap is from one source interval's end to the next one's start, the insert the same
    on the target; a run goes on while gap <= ``max_gap`` and ``min_insert`` <= insert <=
    ``max_insert`` and, with ``max_size``, while it is no longer than that on either side.
    A run starts as its first interval and ends as its last.  With ``blocks`` it has its
    one-to-one intervals as an array of structs, those that touch on both sides as one;
    null where there is one only.
    """
    own, line = keys, Window.partitionBy(*keys).orderBy(*_order())
    gap, insert = F.col("start") - F.lag("stop").over(line), F.col("tgt_start") - F.lag("tgt_stop").over(line)
    cut = F.coalesce((gap > max_gap) | (insert > max_insert) | (insert < min_insert), F.lit(True))
    if max_size is not None:
        runs = aln.withColumn("cut", cut.cast("int")).withColumn("run", F.sum("cut").over(line)).drop("cut")
        keys = (*keys, "run")
        aln, keys = _sized(runs, keys, max_size), (*keys, "piece")
        line = Window.partitionBy(*keys).orderBy(*_order())
        cut = F.row_number().over(line) == 1
    # in order a run is told at its last row, by what its first one was; neither needs an aggregate or a sort of its own
    up_to, at = line.rowsBetween(Window.unboundedPreceding, 0), F.struct("start", "tgt_start", "k")
    touch = (F.lag("stop").over(line) == F.col("start")) & (F.lag("tgt_stop").over(line) == F.col("tgt_start")) if blocks else F.lit(True)
    rows = aln.select(*keys, "start", "stop", "tgt_start", "tgt_stop", cut.alias("cut"), F.row_number().over(line).cast("long").alias("k"), F.coalesce(touch, F.lit(False)).alias("touch"))
    rows = rows.withColumn("new", F.col("cut") | ~F.col("touch"))
    rows = rows.withColumns({"a": F.last(F.when(F.col("new"), at), ignorenulls=True).over(up_to), "last": F.coalesce(F.lead("new").over(line), F.lit(True)), "run_": F.sum(F.col("cut").cast("int")).over(up_to)}).where("last")
    ends = [F.col("a.start").alias("start"), "stop", F.col("a.tgt_start").alias("tgt_start"), "tgt_stop"]
    if not blocks:
        return rows.select(*own, *ends, (F.col("k") - F.col("a.k") + 1).alias("n"))
    each = Window.partitionBy(*keys, "run_").orderBy("k")
    every = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fused = rows.select(*keys, "run_", "k", F.struct(*ends).alias("one"), (F.col("k") - F.col("a.k") + 1).alias("n"))
    out = fused.select(*keys, "one", F.row_number().over(each).alias("place"), F.last("one").over(every).alias("b"), F.sum("n").over(every).alias("n"), F.collect_list("one").over(every).alias("blocks")).where("place = 1")
    shown = F.when(F.size("blocks") > 1, F.sort_array("blocks")).alias("blocks")
    return out.select(*own, F.col("one.start").alias("start"), F.col("b.stop").alias("stop"), F.col("one.tgt_start").alias("tgt_start"), F.col("b.tgt_stop").alias("tgt_stop"), "n", shown)


def _sized(runs: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """``runs`` with a column ``piece``: a new one begins where the piece so far would be longer than ``most``.

    Only runs that are too long as a whole are gone through, row by row, each as a stream.
    """
    run = Window.partitionBy(*keys)
    line = run.orderBy(*_order())
    far = (F.col("stop") - F.first("start").over(line) > most) | (F.col("tgt_stop") - F.first("tgt_start").over(line) > most)
    told = runs.withColumn("far", far).withColumn("far", F.max("far").over(run))
    short = told.where("not far").drop("far").withColumn("piece", F.lit(0).cast("long"))
    long_ = told.where("far").drop("far")
    names = long_.columns
    at = {c: names.index(c) for c in (*keys, "start", "stop", "tgt_start", "tgt_stop")}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, first = None, 0, (0, 0)
        for batch in batches:
            pieces, columns = [], {c: batch.column(i).to_pylist() for c, i in at.items()}
            for i in range(batch.num_rows):
                start, stop, low, high = (columns[c][i] for c in ("start", "stop", "tgt_start", "tgt_stop"))
                key = tuple(columns[c][i] for c in keys)
                if key != now:
                    now, piece, first = key, 0, (start, low)
                elif stop - first[0] > most or high - first[1] > most:
                    piece, first = piece + 1, (start, low)
                pieces.append(piece)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], [*names, "piece"])

    dealt = long_.repartition(*keys).sortWithinPartitions(*keys, *_order())
    return short.union(dealt.mapInArrow(fold, short.schema))


def merged_most(aln: DataFrame, **how) -> DataFrame:
    """:func:`merged` within reason: gaps and inserts to 10,000, ten letters of overlap, no run over 50,000."""
    return merged(aln, 10_000, 10_000, -10, 50_000, **how)


def merged_all(aln: DataFrame) -> DataFrame:
    """One run for each source and target, both strands together, ended by its last interval in source order."""
    at = F.struct("start", (-F.col("stop")).alias("z"), "tgt_start", "tgt_stop")
    out = aln.groupBy("src", "tgt").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"))
    return out.select("src", "tgt", F.col("a.start").alias("start"), (-F.col("b.z")).alias("stop"), F.col("a.tgt_start").alias("tgt_start"), F.col("b.tgt_stop").alias("tgt_stop"), "n")


def _events(intervals: DataFrame, seq: list[str], member: str, start: str, stop: str, width: int) -> DataFrame:
    """(seq, bin, pos, up, down, real): where members begin and end, each member's own overlaps as one; not ``real`` where only a bin's edge cuts.

    One sort and no aggregate: an island is told at its last row.
    """
    told = intervals.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(*seq, member, F.col(start).alias("start"), F.col(stop).alias("stop"))
    own = Window.partitionBy(*seq, member).orderBy("start", "stop")
    told = told.withColumns({"far": F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1)), "next": F.lead("start").over(own)})
    reach, new = F.greatest("far", "stop"), F.col("far").isNull() | (F.col("start") >= F.col("far"))
    first = F.last(F.when(new, F.col("start")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    flat = told.select(*seq, first.alias("start"), reach.alias("stop"), (F.col("next").isNull() | (F.col("next") >= reach)).alias("last")).where("last").drop("last")
    cut = flat.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    low, high = F.greatest("start", F.col("bin") * width), F.least("stop", (F.col("bin") + 1) * width)
    event = lambda pos, up, real: F.struct(pos.alias("pos"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"), real.cast("int").alias("real"))
    return cut.select(*seq, "bin", F.explode(F.array(event(low, 1, low == F.col("start")), event(high, 0, high == F.col("stop")))).alias("e")).select(*seq, "bin", "e.*")


def _swept(intervals: DataFrame, seq: list[str], member: str, start: str, stop: str, width: int) -> DataFrame:
    """(seq, start, stop, depth, dip): stretches between neighbouring ends, with the members open there.

    ``dip`` is how many are open between the ends at ``start`` and the starts there.  A
    sequence is swept in bins of ``width``, each with what is open where it begins, so a
    long one is many tasks; stretches that only a bin's edge parts are joined after.
    """
    events = _events(intervals, seq, member, start, stop, width)
    steps = events.groupBy(*seq, "bin", "pos").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum(F.col("real") * F.col("up")).alias("real_up"), F.sum(F.col("real") * F.col("down")).alias("real_down"))
    line = Window.partitionBy(*seq, "bin").orderBy("pos")
    swept = steps.withColumn("depth", F.sum(F.col("up") - F.col("down")).over(line)).withColumns({"stop": F.lead("pos").over(line), "end_down": F.lead("real_down").over(line)}).where("stop is not null")
    swept = swept.withColumns({"start": F.col("pos"), "dip": F.col("depth") - F.col("up"), "head": F.col("pos") == F.col("bin") * width, "tail": F.col("stop") == (F.col("bin") + 1) * width})
    columns = [*seq, "start", "stop", "depth", "dip"]
    edges = Window.partitionBy(*seq).orderBy("start")  # of the stretches at the bins' edges: two a bin at most
    meets = F.col("head") & (F.lag("stop").over(edges) == F.col("start"))
    before = F.when(meets, F.lag("depth").over(edges) - F.lag("end_down").over(edges)).otherwise(0)
    at_edge = swept.where("head or tail").withColumns({"goes_on": meets & (F.lag("end_down").over(edges) == 0) & (F.col("real_up") == 0), "dip": F.when(F.col("head"), before).otherwise(F.col("dip"))})
    at_edge = at_edge.withColumn("chain", F.sum((~F.coalesce("goes_on", F.lit(False))).cast("int")).over(edges))
    joined = at_edge.groupBy(*seq, "chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("depth").alias("depth"), F.min_by("dip", "start").alias("dip"))
    return swept.where("not (head or tail)").select(columns).union(joined.select(columns)).where("depth > 0")


def depth_regions(intervals: DataFrame, seq: str, member: str, least: int | Column, start: str = "start", stop: str = "stop", width: int = 1 << 16) -> DataFrame:
    """(seq, start, stop, depth): stretches between neighbouring ends at which ``least`` members at least are open.

    A member counts once where its own intervals overlap; at one position ends come before
    starts, so intervals that touch do not overlap.
    """
    return _swept(intervals, [seq], member, start, stop, width).where(F.col("depth") >= least).select(seq, "start", "stop", "depth")


def regions(intervals: DataFrame, seq: list[str], member: str, least: int | Column = 1, start: str = "start", stop: str = "stop", width: int = 1 << 16) -> DataFrame:
    """(seq, start, stop): maximal stretches throughout which ``least`` members at least are open.

    ``least`` may be a column of ``intervals`` that is the same throughout a sequence.
    Where ends at a position leave fewer before others start there, a stretch ends.
    """
    keys, limit = list(seq), least
    if isinstance(least, Column):
        intervals, keys, limit = intervals.withColumn("bound", F.greatest(least, F.lit(1)).cast("long")), [*seq, "bound"], None
    events = _events(intervals, keys, member, start, stop, width).select(*keys, "bin", "pos", (F.col("up") * 2 + F.col("real")).alias("kind"))
    kinds = {f.name: f.dataType for f in events.schema}
    schema = StructType([*[StructField(k, kinds[k]) for k in (*keys, "bin")], *[StructField(k, LongType()) for k in ("start", "stop", "rest")]])
    pieces = events.repartition(*seq, "bin").sortWithinPartitions(*keys, "bin", "pos").mapInArrow(_deep(keys, limit), schema)
    head, tail = F.col("start") == F.col("bin") * width, F.col("stop") == (F.col("bin") + 1) * width
    columns = [*seq, "start", "stop"]
    line = Window.partitionBy(*seq).orderBy("start")  # of what is at the bins' edges: two a bin at most
    bound = F.col("bound") if limit is None else F.lit(max(limit, 1))
    on = F.coalesce(head & (F.lag("stop").over(line) == F.col("start")) & (F.lag("rest").over(line) >= bound), F.lit(False))
    edges = pieces.where(head | tail).withColumn("chain", F.sum((~on).cast("int")).over(line)).groupBy(*seq, "chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return pieces.where(~(head | tail)).select(columns).union(edges.select(columns))


def _deep(keys: list[str], least: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From sorted events (keys, bin, pos, kind) to (keys, bin, start, stop, rest): stretches of a bin throughout which enough members are open.

    ``kind`` is two for a beginning, and one more where it is not a bin's edge that cuts;
    ``rest`` is how many are still open when the ends at ``stop`` are past.  Without
    ``least`` a key ``bound`` has it.  A stream: of what is behind, one position is kept.
    """

    def differs(column: pa.Array) -> np.ndarray:
        a, b = column[:-1], column[1:]
        try:
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        except pa.ArrowNotImplementedError:  # nested
            return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
        return ~same.to_numpy(zero_copy_only=False)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, sums = None, np.zeros((3, 1), np.int64)  # the last position's key, and what begins, ends and really ends there
        before, was, begun = 0, False, 0  # how many are open before it, whether these are enough, and since where
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None and kept is None:
                return
            table = pa.Table.from_batches([x for x in (kept, batch) if x is not None]).combine_chunks().to_batches()[0]
            new, at = np.ones(table.num_rows, bool), table.column("pos").to_numpy()
            group = new.copy()
            group[1:] = np.any([differs(table.column(k)) for k in (*keys, "bin")], axis=0)
            new[1:] = group[1:] | (np.diff(at) != 0)
            step, kind = np.flatnonzero(new), table.column("kind").to_numpy()
            up = kind >> 1
            each = np.stack([up, 1 - up, kind == 1]).astype(np.int64)
            if kept is not None:
                each[:, :1] = sums
                group[0] = opened
            up, down, ended = np.add.reduceat(each, step, axis=1)
            done = len(step) if batch is None else len(step) - 1  # at the last position more may follow
            depth = before + np.cumsum(up - down)[:done]  # none is open where a bin ends, so the sums need not begin anew
            at, first = at[step], group[step]
            bound = np.maximum(table.column("bound").to_numpy(zero_copy_only=False)[step] if least is None else np.full(len(step), least), 1)[:done]
            deep, past = depth >= bound, np.append(before, depth)[:done]
            gone = np.append(was, deep)[:done]
            linked = deep & gone & ~first[:done] & (depth - up[:done] >= bound)
            begins, ends = np.append([begun] * was, at[:done][deep & ~linked]).astype(np.int64), np.flatnonzero(gone & ~linked)
            if len(ends):
                rows = table.select([*keys, "bin"]).take(pa.array(step[ends]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(begins[: len(ends)]), pa.array(at[ends]), pa.array(past[ends] - ended[ends])], [*keys, "bin", "start", "stop", "rest"])
            if done:
                before, was = int(depth[-1]), bool(deep[-1])
                begun = int(begins[-1]) if was else 0
            if batch is not None:
                kept, sums, opened = table.slice(step[-1], 1), np.array([[up[-1]], [down[-1]], [ended[-1]]]), first[-1]

    return fold


def clipped_to(aln: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("src",)) -> DataFrame:
    """The alignment's intervals cut to ``spans(keys, start, stop)`` of the source, the target in lockstep; one row for each span that is met."""
    key = F.struct(*keys)
    both = overlap_join(aln.withColumn("_key", key), spans.select(key.alias("_key"), "start", "stop"), "_key")
    low, high = F.greatest("l_start", "r_start"), F.least("l_stop", "r_stop")
    moved = {"start": low, "stop": high, "tgt_start": F.col("l_tgt_start") + low - F.col("l_start"), "tgt_stop": F.col("l_tgt_stop") + high - F.col("l_stop")}
    return both.select(*[(moved[c] if c in moved else F.col(f"l_{c}")).alias(c) for c in aln.columns])


def grouped_by_sequences(aln: DataFrame, least: int = 1, share: float = 0.0, groups: DataFrame | None = None, source_only: bool = False) -> DataFrame:
    """The intervals of each source, cut to where enough targets are aligned: ``least`` of them, and ``share`` of their number.

    ``groups(tgt, grp)``: each group is looked at by itself and targets of none are left
    out; without it all targets are one.  With ``source_only`` the regions themselves.
    """
    keys, rows, limit = ("src",), aln.where("src is not null"), least
    if groups is not None:
        keys, rows = ("src", "grp"), aln.join(groups.select("tgt", "grp"), "tgt").where("grp is not null")
    if share > 0:
        sizes = rows.groupBy("src") if groups is None else groups.groupBy("grp")
        rows = rows.join(sizes.agg(F.countDistinct("tgt").alias("members")), keys[-1])
        limit = F.greatest(F.lit(least), F.ceil(F.col("members") * share - 1e-9).cast("int"))
    spans = regions(rows, list(keys), "tgt", limit)
    return spans if source_only else clipped_to(rows.select(*keys[1:], *aln.columns), spans, keys)


def split_regions(aln: DataFrame, max_gap: int, max_insert: int, min_insert: int, least: int = 1) -> DataFrame:
    """(src, start, stop): the sources' regions, cut also where a run of :func:`merged` that is not its target's first ends or begins within one."""
    runs = merged(aln, max_gap, max_insert, min_insert)
    line = Window.partitionBy("src", "tgt").orderBy("start")
    runs = runs.withColumn("later", F.row_number().over(line) > 1)
    spans = regions(runs, ["src"], "tgt", least)
    marks = runs.where("later").select("src", F.explode(F.array("start", "stop")).alias("pos")).distinct()
    cuts = overlap_join(spans.select("src", "start", "stop"), marks.select("src", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop")), "src")
    cuts = cuts.where("r_start > l_start").select(F.col("l_src").alias("src"), F.col("l_start").alias("begin"), F.col("l_stop").alias("end"), F.col("r_start").alias("pos"))
    points = cuts.union(spans.select("src", F.col("start").alias("begin"), F.col("stop").alias("end"), F.col("start").alias("pos")))
    return points.select("src", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(Window.partitionBy("src", "begin").orderBy("pos")), F.col("end")).alias("stop"))


def masked(aln: DataFrame, masks: DataFrame, order: str | None = None) -> DataFrame:
    """The rows whose target interval meets the mask of its target, ``masks(tgt, low, high)``, cut to it; the source in lockstep.

    Masks are signed: one on the other strand meets nothing.  A target has one mask: the
    last by ``order``, or else the one with the largest ends.
    """
    span = F.struct("low", "high")
    one = masks.groupBy("tgt").agg((F.max_by(span, order) if order else F.max(span)).alias("m")).select("tgt", "m.low", "m.high")
    x = iv.intersect(F.col("tgt_start"), F.col("tgt_stop"), F.col("low"), F.col("high"))
    rows = aln.join(one, "tgt").withColumn("x", x).where("x is not null")
    moved = {"start": F.col("start") + F.col("x.start") - F.col("tgt_start"), "stop": F.col("stop") + F.col("x.stop") - F.col("tgt_stop"), "tgt_start": F.col("x.start"), "tgt_stop": F.col("x.stop")}
    return rows.select(*[moved.get(c, F.col(c)).alias(c) for c in aln.columns])


def sized(aln: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows whose source interval has ``least`` to ``most`` letters."""
    size = F.col("stop") - F.col("start")
    return aln.where((size >= least if least is not None else F.lit(True)) & (size <= most if most is not None else F.lit(True)))


def with_method(aln: DataFrame, method: Callable[[pd.DataFrame], pd.DataFrame], keys: tuple[str, ...] = ("src", "tgt")) -> DataFrame:
    """A function of one's own in place of the merging rules: it gets a source's and target's rows, in order, and returns such rows."""
    return aln.groupBy(*keys).applyInPandas(lambda rows: method(rows.sort_values(["start", "stop"], ascending=[True, False])), aln.schema)


def clip_blocks(blocks: Column, low: Column, high: Column) -> Column:
    """An array of one-to-one blocks cut to ``[low, high)`` of the source; null where fewer than two are left."""

    def cut(b: Column) -> Column:
        a, z = F.greatest(b["start"], low), F.least(b["stop"], high)
        return F.struct(a.alias("start"), z.alias("stop"), (b["tgt_start"] + a - b["start"]).alias("tgt_start"), (b["tgt_stop"] + z - b["stop"]).alias("tgt_stop"))

    kept = F.transform(F.filter(blocks, lambda b: (b["start"] < high) & (b["stop"] > low)), cut)
    return F.when(F.size(kept) > 1, kept)


def edge_length(aln_start: Column, aln_stop: Column, tgt_start: Column, tgt_stop: Column, mode: Callable[..., Column] = F.greatest) -> Column:
    """The length of an edge: of the longer side, or by another ``mode`` of both."""
    return mode(aln_stop - aln_start, tgt_stop - tgt_start)


def gap_rows(blocks: DataFrame, keys: tuple[str, ...] = ("src", "tgt")) -> DataFrame:
    """(keys, gap_start, gap_stop, insert_start, insert_stop): what lies between consecutive blocks, on either side; null where nothing does."""
    line = Window.partitionBy(*keys).orderBy("start", "stop", "tgt_start", "tgt_stop")
    told = blocks.select(*keys, F.lag("stop").over(line).alias("a"), F.col("start").alias("b"), F.lag("tgt_stop").over(line).alias("c"), F.col("tgt_start").alias("d"))
    gap, insert = F.col("b") > F.col("a"), F.col("d") > F.col("c")
    return told.where(gap | insert).select(*keys, *[F.when(on, F.col(c)).alias(n) for on, c, n in ((gap, "a", "gap_start"), (gap, "b", "gap_stop"), (insert, "c", "insert_start"), (insert, "d", "insert_stop"))])


def aligned(blocks: DataFrame, keys: tuple[str, ...] = ("src", "tgt"), mode: Callable[..., Column] = F.greatest) -> DataFrame:
    """(keys, aligned, length, share): letters of the target in blocks, and their share of the whole edge's length by ``mode``."""
    whole = mode(F.max("stop") - F.min("start"), F.max("tgt_stop") - F.min("tgt_start"))
    return blocks.groupBy(*keys).agg(F.sum(F.col("tgt_stop") - F.col("tgt_start")).alias("aligned"), whole.alias("length")).withColumn("share", F.col("aligned") / F.col("length"))


def lettered(blocks: DataFrame, seqs: DataFrame, seq_id: str = "seq_id", seq: str = "seq") -> DataFrame:
    """``blocks`` with the letters of both sides, ``src_seq`` and ``tgt_seq``; rows of unknown sequences are left out."""
    for side, start, stop in (("src", "start", "stop"), ("tgt", "tgt_start", "tgt_stop")):
        own = seqs.select(F.col(seq_id).alias(side), F.col(seq).alias("_seq"))
        blocks = blocks.join(own, side).withColumn(f"{side}_seq", sq.substring(F.col("_seq"), F.col(start), F.col(stop))).drop("_seq")
    return blocks


def identity(blocks: DataFrame, keys: tuple[str, ...] = ("src", "tgt"), mode: Callable[..., Column] = F.greatest) -> DataFrame:
    """(keys, same, length, share) of blocks with letters: equal letters, whatever the case, and their share of the edge's length.

    A share over 1, where blocks repeat, is left as it is.
    """
    whole = mode(F.max("stop") - F.min("start"), F.max("tgt_stop") - F.min("tgt_start"))
    return blocks.groupBy(*keys).agg(F.sum(sq.identity(F.col("src_seq"), F.col("tgt_seq"))).alias("same"), whole.alias("length")).withColumn("share", F.col("same") / F.col("length"))


def conserved(blocks: DataFrame, least: float = 0.9, least_size: int = 1, keys: tuple[str, ...] = ("src", "tgt"), shortest: bool = False) -> DataFrame:
    """(keys, start, stop, tgt_start, tgt_stop): of each edge the best stretch whose identity is ``least`` or more; edges without one are left out.

    Runs of equal letters are found first.  A stretch is from one run to another; its
    identity is its equal letters by its length on the longer side (``shortest``: the
    shorter), its score all letters compared; the best is the first of the highest score
    that ends first and, of those, begins last.  All stretches of an edge are tried.
    """
    kinds = [f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys]
    mode = np.minimum if shortest else np.maximum

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "tgt_start"])
        where, there, ok = [], [], []
        for start, other, a, b in zip(rows["start"], rows["tgt_start"], rows["src_seq"], rows["tgt_seq"]):
            x, y = (np.frombuffer(t.upper().encode("utf-32-le"), "<u4") for t in (a, b))
            n = min(len(x), len(y))
            where.append(start + np.arange(n))
            there.append(other + np.arange(n))
            ok.append(x[:n] == y[:n])
        one, two, ok = (np.concatenate(x) for x in (where, there, ok))
        hit = np.flatnonzero(ok)
        none = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("start", "stop", "tgt_start", "tgt_stop")})
        if not len(hit):
            return none.assign(**{k: pd.Series(dtype=rows[k].dtype) for k in keys})[[*keys, *none.columns]]
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (np.diff(one[hit]) != 1) | (np.diff(two[hit]) != 1)
        first = hit[new]
        size = np.diff(np.append(np.flatnonzero(new), len(hit)))
        wrong = np.cumsum(~ok)
        a, z, b, y = one[first], one[first] + size, two[first], two[first] + size
        whole, top = np.cumsum(size), None
        for i in range(len(first)):
            same = whole[i] - whole[: i + 1] + size[: i + 1]
            score = same + wrong[first[i]] - wrong[first[: i + 1]]
            fits = np.flatnonzero(same >= least * mode(z[i] - a[: i + 1], y[i] - b[: i + 1]) - 1e-12)
            if len(fits):
                j = int(fits[score[fits] == score[fits].max()][-1])
                if top is None or score[j] > top[0]:
                    top = score[j], j, i
        if top is None or top[0] < least_size:
            return none.assign(**{k: pd.Series(dtype=rows[k].dtype) for k in keys})[[*keys, *none.columns]]
        _, j, i = top
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "start": [a[j]], "stop": [z[i]], "tgt_start": [b[j]], "tgt_stop": [y[i]]})

    return blocks.select(*keys, "start", "tgt_start", "src_seq", "tgt_seq").groupBy(*keys).applyInPandas(best, ", ".join([*kinds, "start long, stop long, tgt_start long, tgt_stop long"]))


def column_letters(blocks: DataFrame) -> DataFrame:
    """(src, pos, letter, tgt, tgt_pos, tgt_letter): a row for each pair of letters that blocks with letters align."""
    at = F.explode(F.sequence(F.lit(0), F.least(F.length("src_seq"), F.length("tgt_seq")) - 1)).alias("i")
    rows = blocks.where("src_seq <> '' and tgt_seq <> ''").select("*", at)
    one = lambda c: F.substring(c, F.col("i") + 1, F.lit(1))
    return rows.select("src", (F.col("start") + F.col("i")).alias("pos"), one(F.col("src_seq")).alias("letter"), "tgt", (F.col("tgt_start") + F.col("i")).alias("tgt_pos"), one(F.col("tgt_seq")).alias("tgt_letter"))


def known_only(aln: DataFrame, ids: DataFrame, column: str = "src", strict: bool = True) -> DataFrame:
    """Rows whose ``column`` is one of ``ids(id)``; with ``strict`` any other makes the query fail, as an unknown sequence."""
    if not strict:
        return aln.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_semi")
    both = aln.join(ids.select(F.col("id").alias(column), F.lit(True).alias("_known")).distinct(), column, "left")
    sure = F.when(F.col("_known"), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown sequence "), F.coalesce(F.col(column).cast("string"), F.lit("null")))))
    return both.withColumn(column, sure).select(aln.columns)
