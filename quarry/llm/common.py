"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are none of the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset on one machine, a temporary folder is made and
    set; on a cluster executors would not share it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quarry-{label}-{uuid.uuid4().hex}"


#: The folder of a scratch() and the tables made in it.
_scratch: ContextVar[tuple[str, list[str]] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[None]:
    """Tables settled within go when it ends, unless they are to be kept. What outlives it must not read them."""
    path, tables = shared_folder(spark, label), []
    before = _scratch.set((path, tables))
    try:
        yield
    finally:
        _scratch.reset(before)
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _new_path(spark: SparkSession, label: str, keep: bool) -> str:
    within = _scratch.get()
    return f"{within[0]}/{label}-{uuid.uuid4().hex}" if within and not keep else shared_folder(spark, label)


def settle_at(df: DataFrame, label: str, keep: bool = False) -> tuple[DataFrame, str]:
    """settle() and the folder of the table, for those who delete it once it isn't read any more."""
    path = _new_path(df.sparkSession, label, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and later uses don't recompute."""
    return settle_at(df, label, keep)[0]


def settle_buckets(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """settle() in buckets by a column, within scratch(): joins on it needn't shuffle what is read back."""
    spark, name = df.sparkSession, f"quarry_{label}_{uuid.uuid4().hex}"
    _scratch.get()[1].append(name)
    df.write.bucketBy(buckets, key).sortBy(key).option("path", _new_path(spark, label, False)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _plain_scan(docs: DataFrame) -> bool:
    """Whether rows of docs are rows of files, each once."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and bool(docs.inputFiles())


def located(docs: DataFrame) -> DataFrame:
    """docs as rows of files: as they are where they are read from files, else settled."""
    return docs if _plain_scan(docs) else settle(docs, "documents", keep=True)


def place_in_files(docs: DataFrame, *columns: str, **more: Column) -> DataFrame:
    """doc_id (as a long) and text (as a string) where they are asked for, and more columns, with the place of each row:
    ``file``, a 64-bit hash of the file's name, and ``row``, its number in it. Two of N files get one hash with a
    probability of N**2 / 2**65."""
    meta = docs.metadataColumn("_metadata")
    types = {"doc_id": "long", "text": "string"}
    asked = [F.col(c).cast(types[c]).alias(c) for c in columns] + [c.alias(name) for name, c in more.items()]
    return docs.select(*asked, F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row"))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
