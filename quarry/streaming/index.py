"""Incremental maintenance of a table of files from a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.repository import wanted

CHANGE = "seq long, path string, change_type string, content string"


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path."""
    last = F.max_by(F.struct("change_type", "content"), "seq").alias("x")
    return changes.groupBy("path").agg(last).select("path", "x.change_type", "x.content")


def applied(files: DataFrame, changes: DataFrame, gitignore: str = "", exclusions: list[str] | None = None) -> DataFrame:
    """files (path, content) after changes: paths that changed go, those that weren't deleted and are indexed come back."""
    last = latest(changes.where(wanted(F.col("path"), gitignore, exclusions)))
    return files.join(last.select("path"), "path", "left_anti").unionByName(last.where("change_type <> 'delete'").select("path", "content"))


#: Batches after which their changes are merged into a new base.
MERGE = 16
_DELTA = "path string, change_type string, content string"


def maintain(spark: SparkSession, changes: DataFrame, table: str, checkpoint: str, gitignore: str = "", after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keep a table of files at ``table``: a base, and what later batches changed.

    A batch writes the last change of each of its paths, and overwrites it when it runs again. Every sixteenth merges base
    and changes into a new base; what that replaces goes once it is written.
    """

    def step(batch: DataFrame, number: int) -> None:
        last = latest(batch.where(wanted(F.col("path"), gitignore)))
        last.write.mode("overwrite").parquet(_place(table, "delta", number))
        if (number + 1) % MERGE == 0:
            if number not in _versions(spark, table, "base"):
                current(spark, table).write.mode("overwrite").parquet(_place(table, "base", number))
            for kind in ("base", "delta"):
                for old in _versions(spark, table, kind):
                    if old < number + (kind == "delta"):
                        _at(spark, _place(table, kind, old))[0].delete(_at(spark, _place(table, kind, old))[1], True)
        if after:
            after(current(spark, table))

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _place(table: str, kind: str, number: int) -> str:
    return f"{table}/{kind}/version={number}"


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, table: str, kind: str) -> list[int]:
    """Numbers of the versions that were written to their end."""
    fs, top = _at(spark, f"{table}/{kind}")
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and fs.exists(_at(spark, f"{table}/{kind}/{n}/_SUCCESS")[1]))


def current(spark: SparkSession, table: str) -> DataFrame:
    """path, content: the newest base with the changes after it; empty if there is nothing."""
    bases = _versions(spark, table, "base")
    files = spark.read.schema("path string, content string").parquet(_place(table, "base", bases[-1])) if bases else spark.createDataFrame([], "path string, content string")
    later = [n for n in _versions(spark, table, "delta") if not bases or n > bases[-1]]
    if not later:
        return files
    rows = spark.read.schema(f"{_DELTA}, version long").option("basePath", f"{table}/delta").parquet(*[_place(table, "delta", n) for n in later])
    last = rows.groupBy("path").agg(F.max_by(F.struct("change_type", "content"), "version").alias("x")).select("path", "x.*")
    return files.join(last.select("path"), "path", "left_anti").unionByName(last.where("change_type <> 'delete'").select("path", "content"))
