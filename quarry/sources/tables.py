"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which the cluster sets; on one machine it is set here if it isn't."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quarry-{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """Tables of one job. A table written here ends the lineage of its rows, so lost executors cost no more than a read."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.top, self.made = spark, shared_folder(spark, label), 0

    def settle(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.top}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, number: int) -> None:
        """Delete a table that nothing reads any more, by the number that ``made`` had when it was written."""
        delete(self.spark, f"{self.top}/{number}")


@contextmanager
def workspace(spark: SparkSession, label: str) -> Iterator[Workspace]:
    """A workspace whose tables go at the end. What outlives it must not read them."""
    work = Workspace(spark, label)
    try:
        yield work
    finally:
        delete(spark, work.top)
