"""Interval, alignment and graph views over the driver's tables, in Spark and, line for line, in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.alignment import lettered


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def iv_orders(spark: SparkSession, d: str) -> DataFrame:
    start = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long")
    return t(spark, d, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 30).alias("stop"))


def iv_events(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01', ts)")
    return t(spark, d, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("id"), start.alias("start"), (start + 1 + F.col("event_id") % 45).alias("stop"))


def aln(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"), day.alias("start")).distinct()
    size, at = 1 + F.col("tgt") % 20, (F.col("tgt") * 7 + F.col("start")) % 1000
    minus = F.col("tgt") % 3 == 0
    return rows.select("src", "start", (F.col("start") + size).alias("stop"), "tgt", F.when(minus, -(at + size)).otherwise(at).alias("tgt_start"), F.when(minus, -at).otherwise(at + size).alias("tgt_stop"))


def g_sp(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("edge"))


def g_ring(spark: SparkSession, d: str) -> DataFrame:
    """A graph of the customers: a leads to b where b is a times 3, 5 or 7, plus 1, modulo their largest key plus 1."""
    n = t(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    of = t(spark, d, "customer").agg(F.max("c_custkey") + 1).scalar()
    return n.select("src", F.explode(F.array(*[F.lit(k).cast("long") for k in (3, 5, 7)])).alias("edge")).select("src", ((F.col("src") * F.col("edge") + 1) % of).alias("dst"), "edge").groupBy("src", "dst").agg(F.min("edge").alias("edge"))


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^acgt]", "").alias("seq")).where("seq <> ''")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of five letters that often touch, with jumps of the target."""
    k = F.col("l_orderkey") % 400
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").cast("long").alias("tgt"), k.alias("k")).distinct()
    low = F.col("k") * 5 + F.floor(F.col("k") / 50) * 30
    return rows.select("src", (F.col("k") * 5).alias("start"), (F.col("k") * 5 + 5).alias("stop"), "tgt", low.alias("tgt_start"), (low + 5).alias("tgt_stop"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 20 letters between each sequence and that of the next id, of every fourth one on the reverse strand."""
    s = seqs(spark, d)
    both = s.select(F.col("doc_id").alias("src"), F.length("seq").alias("a")).join(s.select((F.col("doc_id") - 1).alias("src"), F.length("seq").alias("b")), "src")
    rows = both.select("src", F.floor(F.least("a", "b") / 30).alias("n")).where("n > 0").select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    low, minus = 30 * F.col("i") + F.col("i") % 3, F.col("src") % 4 == 0
    return rows.select("src", (30 * F.col("i")).alias("start"), (30 * F.col("i") + 20).alias("stop"), (F.col("src") + 1).alias("tgt"), F.when(minus, -(low + 20)).otherwise(low).alias("tgt_start"), F.when(minus, -low).otherwise(low + 20).alias("tgt_stop"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`blocks`, with the letters of both sides."""
    return lettered(blocks(spark, d), seqs(spark, d), "doc_id")


SQL = {
    "iv_orders": "SELECT o_custkey AS seq, o_orderkey AS id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS start, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + 1 + o_orderkey % 30 AS stop FROM orders",
    "iv_events": "SELECT user_id AS seq, event_id AS id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 AS start, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 + 1 + event_id % 45 AS stop FROM events",
    "aln": "SELECT src, start, start + size AS stop, tgt, CASE WHEN tgt % 3 = 0 THEN -(pos + size) ELSE pos END AS tgt_start, CASE WHEN tgt % 3 = 0 THEN -pos ELSE pos + size END AS tgt_stop FROM (SELECT *, 1 + tgt % 20 AS size, (tgt * 7 + start) % 1000 AS pos FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS tgt, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS start FROM lineitem))",
    "g_sp": "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS edge FROM lineitem GROUP BY ALL",
    "g_ring": "SELECT src, dst, min(edge) AS edge FROM (SELECT c_custkey AS src, (c_custkey * k + 1) % (SELECT max(c_custkey) + 1 FROM customer) AS dst, k::BIGINT AS edge FROM customer, (VALUES (3), (5), (7)) v(k)) GROUP BY src, dst",
    "exons": "SELECT o_custkey % 200 AS cluster, o_orderkey AS exon, o_orderkey % 40 * 10 AS start, o_orderkey % 40 * 10 + 5 AS stop FROM orders",
    "steps": "SELECT src, k * 5 AS start, k * 5 + 5 AS stop, tgt, k * 5 + k // 50 * 30 AS tgt_start, k * 5 + k // 50 * 30 + 5 AS tgt_stop FROM (SELECT DISTINCT l_suppkey AS src, l_linenumber::BIGINT AS tgt, l_orderkey % 400 AS k FROM lineitem)",
    "seqs": "SELECT doc_id, seq FROM (SELECT doc_id, regexp_replace(text, '[^acgt]', '', 'g') AS seq FROM documents) WHERE seq <> ''",
    "blocks": "SELECT src, 30 * i AS start, 30 * i + 20 AS stop, src + 1 AS tgt, CASE WHEN src % 4 = 0 THEN -(30 * i + i % 3 + 20) ELSE 30 * i + i % 3 END AS tgt_start, CASE WHEN src % 4 = 0 THEN -(30 * i + i % 3) ELSE 30 * i + i % 3 + 20 END AS tgt_stop FROM (SELECT a.doc_id AS src, unnest(range(0, least(length(a.seq), length(b.seq)) // 30)) AS i FROM seqs a JOIN seqs b ON b.doc_id = a.doc_id + 1)",
    "hits": "SELECT b.*, substr(x.seq, b.start + 1, 20) AS src_seq, CASE WHEN tgt_start >= 0 THEN substr(y.seq, tgt_start + 1, 20) ELSE reverse(translate(substr(y.seq, -tgt_stop + 1, 20), 'acgt', 'tgca')) END AS tgt_seq FROM blocks b JOIN seqs x ON x.doc_id = src JOIN seqs y ON y.doc_id = tgt",
}
NEEDS = {"blocks": ("seqs",), "hits": ("seqs", "blocks")}


def sql(body: str) -> str:
    """``body`` with the views it names defined before it."""
    named = {k for k in SQL if re.search(rf"\b{k}\b", body)}
    named |= {need for k in named for need in NEEDS.get(k, ())}
    views = ", ".join(f"{k} AS ({v})" for k, v in SQL.items() if k in named)
    if not named:
        return body
    return f"WITH RECURSIVE {views}, {body[15:]}" if body.startswith("WITH RECURSIVE ") else f"WITH {views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {views} {body}"
