"""What the document operators share: the scratch folder, table reading, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session runs on one machine, as in tests, a local one
    is made; on a cluster an unset one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext.getCheckpointDir()
        if not made:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='strandloom-')}")
            made = spark.sparkContext.getCheckpointDir()
        found = made
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what led to them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{name}{self.n}"

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that :meth:`save` returned and that nothing reads any more.

        Shuffle files go when the driver's JVM finds their plans to be garbage, so it is asked to look.
        """
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(conf).delete(folder, True)
        jvm.System.gc()
