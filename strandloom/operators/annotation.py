"""Annotations: named stretches of sequences, with attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions import sequences as sq


def build(rows: DataFrame, seqs: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Rows (id, seq_id, start, stop, ...) as annotations: signed by ``orientation``, where there is such a column.

    A negative orientation turns an interval that is forward.  An empty interval and, with
    ``seqs(seq_id)``, an unknown sequence are errors as the query runs; without ``strict``
    such rows are left out.
    """
    start, stop = F.col("start").cast("long"), F.col("stop").cast("long")
    if "orientation" in rows.columns:
        back = (F.col("orientation") < 0) & (start >= 0)
        start, stop = F.when(back, -stop).otherwise(start), F.when(back, -start).otherwise(stop)
    out = rows.withColumns({"start": start, "stop": stop})
    told = lambda what: F.raise_error(F.concat(F.lit("annotation "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(what)))
    full = F.coalesce(F.col("start") < F.col("stop"), F.lit(False))
    out = out.withColumn("start", F.when(full, F.col("start")).otherwise(told(" is empty"))) if strict else out.where(full)
    if seqs is not None:
        known = seqs.select("seq_id", F.lit(True).alias("_known")).distinct()
        out = out.join(known, "seq_id", "left" if strict else "inner")
        if strict:
            out = out.withColumn("seq_id", F.when(F.col("_known"), F.col("seq_id")).otherwise(told(" is of no known sequence")))
    return out.select(rows.columns)


def contains(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids(id)`` with ``known``: whether there is an annotation of that id."""
    return ids.join(annotations.select("id", F.lit(True).alias("known")).distinct(), "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def slice_of(start: Column, stop: Column, low: Column, high: Column) -> Column:
    """Where ``[low:high]`` of an annotation, in its own direction, lies on its sequence."""
    return iv.pair(start + low, F.least(start + high, stop))


def added(annotations: DataFrame, new: DataFrame, seqs: DataFrame | None = None) -> DataFrame:
    """Annotations and new ones, which are checked first; one with an id that is there already takes its place."""
    new = build(new, seqs).select(annotations.columns)
    return annotations.join(new.select("id"), "id", "left_anti").select(annotations.columns).unionByName(new)


def with_attributes(hits: DataFrame, annotations: DataFrame, *names: str, key: str = "ann_id") -> DataFrame:
    """Slices of annotations with attributes of these."""
    return hits.join(annotations.select(F.col("id").alias(key), *names), key, "left")


def letters(annotations: DataFrame, seqs: DataFrame) -> DataFrame:
    """Annotations with their letters, as ``seq``; those of the reverse strand are turned."""
    return annotations.join(seqs.select("seq_id", F.col("seq").alias("_whole")), "seq_id").withColumn("seq", sq.substring(F.col("_whole"), F.col("start"), F.col("stop"))).drop("_whole")


def from_hits(hits: DataFrame, max_loss: int | None = None, most: int = 999_999, strict: bool = True) -> DataFrame:
    """Annotations (id, seq_id, start, stop) for the hits (src, start, stop, tgt, tgt_start, tgt_stop, length) of each source.

    With ``max_loss`` a hit has to cover all of the source's ``length`` but so much.  A
    source with one hit gives its own id, one with several ``<id>_0``, ``<id>_1`` ... in
    order; one with more than ``most`` is an error, or left out where not ``strict``.
    """
    kept = hits if max_loss is None else hits.where(F.col("stop") - F.col("start") >= F.col("length") - max_loss)
    counts = kept.groupBy("src").agg(F.count("*").alias("n"))
    over = F.raise_error(F.concat(F.lit("too many hits for "), F.col("src").cast("string")))
    counts = counts.withColumn("n", F.when(F.col("n") <= most, F.col("n")).otherwise(over)) if strict else counts.where(F.col("n") <= most)
    place = F.row_number().over(Window.partitionBy("src").orderBy("start", "tgt", "tgt_start", "tgt_stop")) - 1
    name = F.when(F.col("n") > 1, F.concat(F.col("src").cast("string"), F.lit("_"), F.col("place").cast("string"))).otherwise(F.col("src").cast("string"))
    return kept.withColumn("place", place).join(counts, "src").select(name.alias("id"), F.col("tgt").alias("seq_id"), F.col("tgt_start").alias("start"), F.col("tgt_stop").alias("stop"))


def frames(seqs: DataFrame) -> DataFrame:
    """The six reading frames of each sequence as annotations (id, seq_id, start, stop, frame), named ``<seq_id>:0`` to ``:2`` and ``:-0`` to ``:-2``."""
    found = seqs.select("seq_id", F.explode(sq.six_frames(F.length("seq"))).alias("x")).select("seq_id", "x.*")
    name = F.concat(F.col("seq_id").cast("string"), F.lit(":"), F.when(F.col("frame") < 0, "-").otherwise(""), (F.abs("frame") - 1).cast("string"))
    return found.select(name.alias("id"), "seq_id", "start", "stop", "frame")


def frame_hits(hits: DataFrame, frames_: DataFrame) -> DataFrame:
    """Hits (src, start, stop, ...) on translated sequences, with the frame that each is in: ``src`` is then the frame's id.

    A hit lies in the frame of its strand whose begin it is a whole number of codons from.
    """
    own = frames_.select(F.col("seq_id").alias("src"), F.col("id").alias("_id"), F.col("start").alias("_a"), F.col("stop").alias("_z"))
    both = hits.join(own, "src").where((F.col("start") >= F.col("_a")) & (F.col("stop") <= F.col("_z")) & ((F.col("start") >= 0) == (F.col("_a") >= 0)) & (F.pmod(F.col("start") - F.col("_a"), F.lit(3)) == 0))
    return both.withColumns({"start": F.floor((F.col("start") - F.col("_a")) / 3), "stop": F.floor((F.col("stop") - F.col("_a")) / 3)}).withColumn("src", F.col("_id")).select(hits.columns)
