"""Interval text, coordinate tuples, alignment dumps, database tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(start, stop, tgt, tgt_start, tgt_stop) of lines of five numbers with white space between; other lines are left out."""
    f = F.split(F.trim("value"), r"\s+")
    names = ("start", "stop", "tgt", "tgt_start", "tgt_stop")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*(-?\d+\s+){4}-?\d+\s*$"))
    return lines.select(*[F.get(f, F.lit(i)).cast("long").alias(n) for i, n in enumerate(names)])


def from_tuples(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """(src, start, stop, tgt, tgt_start, tgt_stop) of rows with columns of any names.

    ``names`` gives the column for each of ``id``, ``start``, ``stop``, ``idDest``,
    ``startDest``, ``stopDest`` and, where strands are told apart, ``ori`` and ``oriDest``:
    below 0 the interval is turned.
    """
    out = []
    for end, made in (("", ("src", "start", "stop")), ("Dest", ("tgt", "tgt_start", "tgt_stop"))):
        a, b = F.col(names[f"start{end}"]).cast("long"), F.col(names[f"stop{end}"]).cast("long")
        back = F.col(names[f"ori{end}"]) < 0 if f"ori{end}" in names else F.lit(False)
        out += [F.col(names[f"id{end}"]).alias(made[0]), F.when(back, -b).otherwise(a).alias(made[1]), F.when(back, -a).otherwise(b).alias(made[2])]
    return rows.select(out)


def write_dump(aln: DataFrame, path: str) -> None:
    """An alignment as text that any machine reads: a tab between the columns and a line for each row."""
    aln.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("src", "start", "stop", "tgt", "tgt_start", "tgt_stop")]).alias("value")).write.text(path)


def read_dump(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=f"src {id_type}, start long, stop long, tgt {id_type}, tgt_start long, tgt_stop long")


def write_sorted(aln: DataFrame, path: str, partitions: int | None = None) -> None:
    """An alignment by source and place, so that the files' statistics tell which parts a query needs."""
    ranged = aln.repartitionByRange(partitions, "src", "start") if partitions else aln.repartitionByRange("src", "start")
    ranged.sortWithinPartitions("src", "start", F.desc("stop")).write.parquet(path)


def save_table(rows: DataFrame, name: str, index: list[str] | None = None, buckets: int = 8, path: str | None = None) -> None:
    """Rows as a table of the catalog; those of ``index``, or else all columns that end in ``_id``, are what it is bucketed by.

    With ``path`` the files are there and not in the warehouse.
    """
    keys = [c for c in rows.columns if c.endswith("_id")] if index is None else index
    writer = rows.write.mode("overwrite")
    writer = writer.option("path", path) if path else writer
    (writer.bucketBy(buckets, *keys).sortBy(*keys) if keys else writer).saveAsTable(name)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric ``key``; ``options``: driver, user, password, fetchsize."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        low, high = bounds
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions)
    return reader.load()


MODES = {"c": "ignore", "n": "overwrite", "w": "append"}


class Shelf:
    """Values by key, in a folder: opened to read (``r``), to write (``w``), to write, made where it is missing (``c``), or anew (``n``)."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "r"):
        if mode not in (*MODES, "r"):
            raise ValueError(f"mode {mode!r}")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        there = self._folder().exists(self._path(self.path))
        if mode in "rw" and not there:
            raise FileNotFoundError(path)
        if mode == "n" and there:
            self._folder().delete(self._path(self.path), True)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _folder(self):
        return self._path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, rows: DataFrame) -> None:
        """``rows(key, value)``, written beside what is there; of a key the last written stands."""
        if self.mode == "r":
            raise ValueError("opened to read")
        n = len(self._folder().listStatus(self._path(self.path))) if self._folder().exists(self._path(self.path)) else 0
        rows.select("key", "value").write.parquet(f"{self.path}/part={n}")

    def all(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.groupBy("key").agg(F.max_by("value", "part").alias("value"))

    def get(self, key: object) -> object:
        found = self.all().where(F.col("key") == key).select("value").first()
        if found is None:
            raise KeyError(key)
        return found.value
