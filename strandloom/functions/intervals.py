"""Column functions over strand-aware intervals.

An interval is half-open and never empty.  The strand is the sign of its start:
``[3, 8)`` on the reverse strand is ``[-8, -3)``.  A function whose result would be
empty returns null.  Each takes and returns columns; a pair is a struct (start, stop).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair(start: Column, stop: Column) -> Column:
    """A struct (start, stop), or null where that is empty."""
    return F.when(start < stop, F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop")))


def orientation(start: Column) -> Column:
    return F.when(start >= 0, 1).otherwise(-1)


def absolute(start: Column, stop: Column) -> Column:
    """The interval on the forward strand."""
    return pair(F.when(start >= 0, start).otherwise(-stop), F.when(start >= 0, stop).otherwise(-start))


def flip(start: Column, stop: Column) -> Column:
    return pair(-stop, -start)


def oriented(start: Column, stop: Column, like: Column) -> Column:
    """The interval on the strand of ``like``, which is a start."""
    same = (start >= 0) == (like >= 0)
    return pair(F.when(same, start).otherwise(-stop), F.when(same, stop).otherwise(-start))


def overlaps(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    return (a_start < b_stop) & (b_start < a_stop)


def contains(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    return (a_start <= b_start) & (b_stop <= a_stop)


def intersect(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """What two intervals of one sequence and strand share; null across strands."""
    same = (a_start >= 0) == (b_start >= 0)
    return F.when(same, pair(F.greatest(a_start, b_start), F.least(a_stop, b_stop)))


def span(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """The least interval that covers both, with whatever lies between."""
    return pair(F.least(a_start, b_start), F.greatest(a_stop, b_stop))


def before(start: Column) -> Column:
    """From the sequence's start to the interval, on the forward strand."""
    return pair(F.lit(0), start)


def after(stop: Column, length: Column) -> Column:
    """From the interval to the sequence's end, on the forward strand."""
    return pair(stop, length)


def sliced(start: Column, stop: Column, low: Column, high: Column) -> Column:
    """``[low:high]`` of an interval, in its own direction.

    Negative bounds count from its end, bounds outside are clipped, and ``low > high``
    takes the stretch between on the other strand.
    """
    n = stop - start
    at = lambda x: F.least(F.greatest(F.when(x < 0, n + x).otherwise(x), F.lit(0)), n)
    i, j = at(low), at(high)
    return F.when(i <= j, pair(start + i, start + j)).otherwise(pair(-(start + i), -(start + j)))


def transformed(x: Column, src_start: Column, src_stop: Column, dst_start: Column, dst_stop: Column) -> Column:
    """A position of the source interval in the destination's coordinates; the scale's fraction is cut off."""
    return dst_start + ((x - src_start) * (dst_stop - dst_start) / (src_stop - src_start)).cast("long")


def clip_transformed(low: Column, high: Column, src_start: Column, src_stop: Column, dst_start: Column, dst_stop: Column) -> Column:
    """An interval of the source, clipped to it first, in the destination's coordinates; null outside."""
    a, b = F.greatest(low, src_start), F.least(high, src_stop)
    return F.when(a < b, pair(transformed(a, src_start, src_stop, dst_start, dst_stop), transformed(b, src_start, src_stop, dst_start, dst_stop)))


def size(start: Column, stop: Column, step: int = 1) -> Column:
    """The length, in units of ``step`` letters, one at least."""
    return F.greatest(F.floor((stop - start) / step), F.lit(1))


def is_full_length(start: Column, stop: Column, length: Column) -> Column:
    """Whether the interval is its whole sequence, on either strand."""
    return ((start == 0) & (stop == length)) | ((start == -length) & (stop == 0))


def equal(a_seq: Column, a_start: Column, a_stop: Column, b_seq: Column, b_start: Column, b_stop: Column) -> Column:
    """Whether two intervals are the same stretch of the same strand of one sequence."""
    return a_seq.eqNullSafe(b_seq) & (a_start == b_start) & (a_stop == b_stop)


def order_key(seq: Column, start: Column, stop: Column) -> Column:
    """What intervals are ordered and hashed by: the sequence, then start and stop."""
    return F.struct(seq.alias("seq"), start.alias("start"), stop.alias("stop"))


def absolute_slice(start: Column, stop: Column) -> Column:
    """``[start:stop]`` of a whole sequence by signed coordinates: both may be negative, which is the reverse strand.

    The same as the pair itself; ``start`` not before ``stop`` is empty and null.
    """
    return pair(start, stop)


def relative_slice(start: Column, stop: Column, low: Column, high: Column) -> Column:
    """``[low:high]`` counted from the interval's start, in its own direction, ``low`` and ``high`` signed: negative is its other strand."""
    return F.when(low >= 0, pair(start + low, start + high)).otherwise(pair(-start + low, -start + high))


def record(seq: Column, start: Column, stop: Column, prefix: str = "") -> list[Column]:
    """The interval as columns ``id``, ``start``, ``end`` on the forward strand and ``ori`` (1 or -1), with a prefix."""
    place = absolute(start, stop)
    return [seq.alias(f"{prefix}id"), place["start"].alias(f"{prefix}start"), place["stop"].alias(f"{prefix}end"), orientation(start).alias(f"{prefix}ori")]


def reoriented(src_start: Column, src_stop: Column, dst_start: Column, dst_stop: Column, forward: bool = True) -> Column:
    """A struct (start, stop, tgt_start, tgt_stop): both sides turned, so that the source is on the strand asked for."""
    turn = (src_start < 0) if forward else (src_start >= 0)
    ends = {"start": (src_start, src_stop), "stop": (src_stop, src_start), "tgt_start": (dst_start, dst_stop), "tgt_stop": (dst_stop, dst_start)}
    return F.struct(*[F.when(turn, -other).otherwise(own).alias(name) for name, (own, other) in ends.items()])


def frame(start: Column) -> Column:
    """Reading frame of a translated interval: 1 to 3, or -1 to -3 on the reverse strand."""
    return F.when(start >= 0, F.pmod(start, F.lit(3)) + 1).otherwise(-(F.pmod(start + 1, F.lit(3)) + 1))
