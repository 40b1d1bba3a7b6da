"""The interval-overlap join.

Both sides are cut into bins, and equal bins of a sequence meet in an equi-join, so a
sequence with very many intervals is spread over many keys.  Bins come in levels, each
``step`` times as wide as the one below.  An interval is stored at one level, the lowest
at which a bin is as wide as it is, so in two bins at most (more only above the last
level).  A pair meets at the level of the wider one, where the narrower one looks for it:
one join for those of the left that are as wide or wider, one for those of the right that
are wider.  The level is part of the key, so a row never meets what is stored elsewhere.
A pair that shares several bins is kept in the one in which the later of the two begins,
so nothing has to be made distinct afterwards.

Which levels a side has at all is found out as the query runs; a side looks into those of
the other only.  If all intervals are of one level, no row is repeated for another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv


def _sided(df: DataFrame, side: str, seq: str, start: str, stop: str) -> DataFrame:
    """The columns with a prefix, and the interval's ends on the forward strand, which are the larger of each end and the other's negative."""
    low, high = F.greatest(F.col(start), -F.col(stop)).cast("long"), F.greatest(F.col(stop), -F.col(start)).cast("long")
    valid = F.col(seq).isNotNull() & (F.col(start) < F.col(stop))
    return df.where(valid).select(*[F.col(c).alias(f"{side}{c}") for c in df.columns], low.alias(f"{side}_abs_low"), high.alias(f"{side}_abs_high"))


def _level(size: Column, width: int, step: int, levels: int) -> Column:
    return reduce(Column.__add__, [(size > width * step**k).cast("int") for k in range(levels - 1)], F.lit(0))


def overlap_join(left: DataFrame, right: DataFrame, seq: str = "seq", start: str = "start", stop: str = "stop", width: int = 64, step: int = 16, levels: int = 7) -> DataFrame:
    """Every pair of rows whose intervals overlap on the forward strand; columns are prefixed ``l_`` and ``r_``.

    Signed intervals meet by their absolute place.  The right interval is also given on the
    strand of the left one, as ``hit_start`` and ``hit_stop``.  Null sequences and bounds
    and empty intervals meet nothing.
    """
    sides = {"l_": _sided(left, "l_", seq, start, stop), "r_": _sided(right, "r_", seq, start, stop)}
    widths, shift = F.array(*[F.lit(width * step**k) for k in range(levels)]), lambda n: F.call_function("shiftleft", F.lit(1), n)
    levelled = {s: x.withColumn(f"{s}_level", _level(F.col(f"{s}_abs_high") - F.col(f"{s}_abs_low"), width, step, levels)) for s, x in sides.items()}
    found = {s: x.agg(F.coalesce(F.bit_or(shift(F.col(f"{s}_level"))), F.lit(0))).scalar() for s, x in levelled.items()}  # a bit for each level
    placed = {}
    for own, other in (("l_", "r_"), ("r_", "l_")):
        mine, level, code = F.col(f"{own}_level"), F.col(f"{own}_at"), f"{own}_code"
        asked = found[other].bitwiseAND(shift(level)) != 0
        rows = levelled[own].withColumn(f"{own}_at", F.explode(F.sequence(mine, F.lit(levels - 1)))).where((level == mine) | asked)
        if own == "l_":  # which of the two meetings a row is in: the left is stored (0), or the right (1)
            rows = rows.withColumn("_turn", (level > mine).cast("int"))
        else:
            narrower = found[other].bitwiseAND(shift(mine) - 1) != 0
            rows = rows.withColumn("_turn", F.explode(F.when((level == mine) & narrower, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        size = F.element_at(widths, level + 1)
        low, high = F.col(f"{own}_abs_low"), F.col(f"{own}_abs_high")
        rows = rows.withColumn("_bin", F.explode(F.sequence(F.floor(low / size), F.floor((high - 1) / size))))
        placed[own] = rows.withColumn(code, F.col("_bin") * (2 * levels) + level * 2 + F.col("_turn")).drop("_turn", "_bin", f"{own}_level")
    x, y = placed["l_"], placed["r_"].drop("r__at")
    first = F.floor(F.greatest("l__abs_low", "r__abs_low") / F.element_at(widths, F.col("l__at") + 1)) == F.floor(F.col("l__code") / (2 * levels))
    meet = iv.overlaps(F.col("l__abs_low"), F.col("l__abs_high"), F.col("r__abs_low"), F.col("r__abs_high"))
    out = x.join(y, (F.col(f"l_{seq}") == F.col(f"r_{seq}")) & (F.col("l__code") == F.col("r__code")) & first & meet)
    hit = iv.oriented(F.col(f"r_{start}"), F.col(f"r_{stop}"), F.col(f"l_{start}"))
    keep = [f"l_{c}" for c in left.columns] + [f"r_{c}" for c in right.columns]
    return out.select(*keep, hit["start"].alias("hit_start"), hit["stop"].alias("hit_stop"))


def clipped(joined: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """With ``clip_start`` and ``clip_stop``: what of the left interval the right one covers."""
    both = iv.intersect(F.col(f"l_{start}"), F.col(f"l_{stop}"), F.col("hit_start"), F.col("hit_stop"))
    return joined.withColumn("clip_start", both["start"]).withColumn("clip_stop", both["stop"])


def adjacent(intervals: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """(keys, l_..., r_...): pairs of one sequence and strand, ``keys``, of which the right begins where the left ends."""
    rest = [c for c in intervals.columns if c not in keys]
    a, b = (intervals.select(*keys, *[F.col(c).alias(f"{side}{c}") for c in rest], F.col(at).alias("_at")) for side, at in (("l_", stop), ("r_", start)))
    return a.join(b, [*keys, "_at"]).drop("_at")


def covering(intervals: DataFrame, seq: str = "seq", start: str = "start", stop: str = "stop") -> DataFrame:
    """(seq, start, stop): for each sequence the one interval that covers all, what lies between them included."""
    return intervals.groupBy(seq).agg(F.min(start).alias(start), F.max(stop).alias(stop))


def masked(intervals: DataFrame, masks: DataFrame, seq: str = "seq", order: str | None = None) -> DataFrame:
    """What of each interval its sequence's mask, ``masks(seq, low, high)``, lets through; a sequence has one mask, the last by ``order`` or the one with the largest ends."""
    span = F.struct("low", "high")
    one = masks.groupBy(seq).agg((F.max_by(span, order) if order else F.max(span)).alias("_m"))
    x = iv.intersect(F.col("start"), F.col("stop"), F.col("_m.low"), F.col("_m.high"))
    found = intervals.join(one, seq).withColumn("_x", x).where("_x is not null")
    return found.withColumns({"start": F.col("_x.start"), "stop": F.col("_x.stop")}).select(intervals.columns)
