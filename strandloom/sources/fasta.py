"""FASTA files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(seq_id, title, seq, length): the id is the first word after ``>``; records without letters are left out.

    ``strict``: a file in which nothing can be read is an ``OSError``, at once.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", r"^>", "")
    head = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    letters = F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"[^\x21-\x7E]", "")
    title = F.trim(F.regexp_extract(head, r"^\s*\S+\s*(.*)$", 1))
    out = records.select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("seq_id"), title.alias("title"), letters.alias("seq"))
    out = out.where("seq <> ''").withColumn("length", F.length("seq"))
    if strict and out.select("seq_id").limit(1).count() == 0:
        raise OSError(f"no sequence can be read in {path}")
    return out


def read_one(spark: SparkSession, path: str) -> str:
    """The letters of the first record of a file."""
    found = read(spark, path).select("seq").first()
    if found is None:
        raise OSError(f"no sequence can be read in {path}")
    return found.seq


def checked(records: DataFrame) -> DataFrame:
    """Records (seq_id, seq, length, ...) of any reader; one whose length is not that of its letters is an error as the query runs."""
    told = F.concat(F.lit("the length of "), F.col("seq_id").cast("string"), F.lit(" is not that of its letters"))
    return records.withColumn("length", F.when(F.col("length") == F.length("seq"), F.col("length")).otherwise(F.raise_error(told)))


def read_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(seq_id, seq, length) of lines ``id,sequence``."""
    rows = spark.read.csv(path, header=header, schema="seq_id string, seq string")
    return rows.where("seq is not null").withColumn("length", F.length("seq"))


def chunked(records: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(seq_id, chunk, letters): sequences in pieces, so that a part of a long one is read without the rest."""
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size))).alias("chunk")
    return records.where("seq <> ''").select("seq_id", "seq", at).select("seq_id", "chunk", F.substring("seq", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("letters"))


def parts(chunks: DataFrame, intervals: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``intervals(seq_id, start, stop, ...)``, forward, with their letters as ``part``: each meets only the chunks that it is in."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("chunk")
    asked = intervals.where("start < stop").select("*", cells)
    low, high = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0)), F.least(F.col("stop") - F.col("chunk") * size, F.lit(size))
    cut = asked.join(chunks, ["seq_id", "chunk"]).select(*intervals.columns, F.struct("chunk", F.substring("letters", (low + 1).cast("int"), (high - low).cast("int")).alias("s")).alias("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["s"]), "")
    return cut.groupBy(*intervals.columns).agg(whole.alias("part"))


def numbered(seqs: DataFrame, order: str | Column) -> DataFrame:
    """Sequences without ids, numbered from 0 in order.  Numbers that are dense take one sort of all; only ``order`` and the number go through it."""
    return seqs.withColumn("seq_id", (F.row_number().over(Window.orderBy(order)) - 1).cast("string"))


def write(df: DataFrame, path: str, width: int = 60) -> None:
    """One record for each row (seq_id, seq), letters in lines of ``width``; rows without an id get one: ``seq`` and a number."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    name = F.coalesce(F.col("seq_id").cast("string"), F.concat(F.lit("seq"), F.monotonically_increasing_id().cast("string")))
    df.select(F.concat(F.lit(">"), name, F.lit("\n"), lines).alias("value")).write.text(path)
