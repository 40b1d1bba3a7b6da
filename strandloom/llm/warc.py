"""A content-addressed WARC archive.

An archive is two tables in one folder.  ``payloads`` holds each payload's bytes once,
by SHA-256.  ``headers`` holds each record's header bytes exactly as they stand in the
WARC file, with the digest of its payload.  Records are made again by a join on the
digest.  A digest is verified twice: rows that share one must agree in length and in
two other hashes when the archive is written, and the bytes are hashed again when read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
EPOCH = "1970-01-01T00:00:00Z"
_END = "\r\n"


def _uuid(digest: Column) -> Column:
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def _record_id(id_: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), _uuid(F.sha2(F.concat(F.lit("record "), F.coalesce(id_.cast("string"), F.lit(""))), 256)), F.lit(">"))


def _clean(value: Column) -> Column:
    """Line ends would end a header line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, date: str = EPOCH) -> None:
    """Writes an archive of one record for each row of ``pages`` to ``folder``.

    Null payloads are empty.  Of the records with equal payloads of at least ``least``
    bytes the one with the smallest id is a response and the others are revisits of it;
    smaller payloads are all responses.  Rows that repeat the smallest id are responses
    too; a null id counts as the largest.  Other columns are not read.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload"))
    hashed = source.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # Partial aggregation meets each digest once a task, so copies are not shuffled.
    proof = F.struct(F.col("size"), F.xxhash64("payload"), F.md5("payload"))
    once = hashed.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(proof).alias("low"), F.max(proof).alias("high"))
    once.select("digest", F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("payload")).write.parquet(f"{folder}/payloads")
    rows = hashed.select("id", "url", "digest", "size")
    owners = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("owner"))
    typed = rows.join(owners, "digest", "left").withColumn("revisit", ~F.coalesce(F.col("id") == F.col("owner"), F.col("owner").isNull()))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    header = F.concat(
        F.lit(VERSION + _END),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("owner"))), line("X-Refers-To", F.col("owner").cast("string")))).otherwise(""),
        F.when(F.col("id").isNull(), "").otherwise(line("X-Record-Key", F.col("id").cast("string"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(_END),
    )
    typed.select(F.encode(header, "utf-8").alias("header"), "digest").write.parquet(f"{folder}/headers")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(header, payload, record) for every record of an archive.

    ``payload`` is the full payload, a revisit's by its digest; ``record`` is the record's
    exact bytes, in which a revisit has an empty block.  A payload whose SHA-256 is not
    its digest, or that is missing, raises an error.
    """
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    payload = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not have its digest")))
    both = headers.join(payloads, "digest", "left").select("header", payload.alias("payload"))
    block = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.withColumn("record", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")))


def field(name: str, header: str = "header") -> Column:
    """A header field of a record; empty where it has none."""
    return F.regexp_extract(F.decode(F.col(header), "utf-8"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def parsed(records: DataFrame) -> DataFrame:
    """(header, payload) from the bytes of each record: its block is what the header's length says, after the first empty line.

    A revisit's block is empty, so its payload is the one that was joined to it.  A record
    that is shorter than it says, or does not end as records do, raises an error.
    """
    text = F.decode("record", "iso-8859-1")  # a character a byte
    cut = records.select("record", "payload", (F.instr(text, _END * 2) + 3).alias("at"), F.octet_length("record").alias("size"))
    cut = cut.withColumn("header", F.expr("substring(record, 1, at)"))
    length = field("Content-Length").cast("int")
    whole = (F.col("size") == F.col("at") + length + 4) & (F.expr("substring(record, size - 3, 4)") == F.lit(b"\r\n\r\n"))
    block = F.when(whole, F.expr("substring(record, at + 1, size - at - 4)")).otherwise(F.raise_error(F.lit("a record is not as long as it says")))
    return cut.select("header", F.when(field("WARC-Type") == "revisit", F.coalesce(F.col("payload"), block)).otherwise(block).alias("payload"))


def summary(records: DataFrame, id_type: str = "long") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of records as :func:`read` returns them.

    All is taken from the records' own bytes, see :func:`parsed`; a revisit's payload from what is joined to it.
    """
    return parsed(records).select(
        F.nullif(field("X-Record-Key"), F.lit("")).cast(id_type).alias("id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.nullif(field("X-Refers-To"), F.lit("")).cast(id_type).alias("refers_to"),
    )


def export(spark: SparkSession, archive: str, folder: str) -> None:
    """Writes the records as WARC files: the text writer ends every record with the two line ends that WARC wants.

    For archives whose payloads are UTF-8, such as those that :func:`write` makes.
    """
    records = read(spark, archive)
    block = F.when(field("WARC-Type") == "revisit", F.lit("")).otherwise(F.decode("payload", "utf-8"))
    records.select(F.concat(F.decode("header", "utf-8"), block).alias("value")).write.option("lineSep", "\r\n\r\n").text(folder)
