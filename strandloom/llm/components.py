"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the smallest node reachable.

    Alternates large-star and small-star steps.  Each is a minimum per node, combined
    before the shuffle, and an equi-join, which AQE can split at a hot node; no
    neighbour list is ever gathered.  Every round is a table in the shared folder.
    No edges: no rows.  Loops and repeated edges are harmless; null ends are left out.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.where("u <> v").distinct())
        scratch.drop(now)
        now, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
