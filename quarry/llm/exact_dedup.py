"""Exact deduplication by a stateful stream.

Files are read as a stream. The state, kept on disk by key and never expired, has for each digest and length of a
normalised text the first row (smallest id), where its content lies (file and row) and how many rows were seen. After a
run, every row that hit an entry is compared with the entry's content byte by byte; should texts differ under one
digest, those keys are grouped by the texts themselves. Only DataFrame functions touch the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, settle, shared_folder

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every small store takes megabytes ahead
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Each row with its digest, its length and the row's own place; the text stays lazy until it is asked for."""
    meta = F.col("_metadata")
    text = normalised(F.col("text"))
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    return row.withColumn("digest", digest(text)).withColumn("length", F.octet_length(text))


def _place() -> Column:
    """Ids in order, a null id after all others."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")


def seen(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over the files that ``state`` hasn't seen; one row per key: digest, length, first, n.

    ``state`` is a folder in the shared store: the stream's checkpoint with its keyed state, and what each batch changed.
    Run again after new files came, it reads only those.
    """
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    # the file source takes a path that is one file only as a pattern
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    keys = _rows(source.parquet(pattern), digest).groupBy("digest", "length").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/changed/batch={batch}")  # a batch that runs again replaces itself

    with _settings(spark, _STORE):
        run = keys.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    schema = "digest string, length int, first struct<none: boolean, doc_id: bigint, file: string, row: bigint>, n bigint, batch int"
    changed = spark.read.schema(schema).parquet(f"{state}/changed")
    return changed.groupBy("digest", "length").agg(F.max_by(F.struct("first", "n"), "batch").alias("last")).select("digest", "length", "last.first", "last.n")


#: Rows of a group that one task compares with the group's content, about.
SPREAD = 1000


def deduplicate(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """One row per row of the documents at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical once every run of ASCII spaces is one space; null counts as empty. The row with
    the smallest id stays; of rows with equal ids the one that comes first by file and row, and a null id comes last. A
    very long text is hashed and compared as a whole. No rows: no rows. Repeated rows are documents each. Extra columns are
    ignored. ``digest`` may be weak: differing texts are told apart by their bytes. A group's content goes to as many
    tasks as its size asks for, so that no task compares a large group alone.
    """
    docs = spark.read.parquet(path)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    keys = settle(seen(spark, path, state or shared_folder(spark, "seen"), digest, files_per_batch), "seen")
    key = keys.select(F.col("digest").alias("d"), F.col("length").alias("l"), "first", "n")
    same_key = (F.col("digest") == F.col("d")) & (F.col("length") == F.col("l"))
    text = normalised(F.col("text"))
    # one pass over the texts: every row with its entry, the text only where it hit another row's entry
    found = _rows(docs, digest).withColumn("text_sha256", F.col("digest") if digest is sha256 else sha256(text)).join(key, same_key)
    rows = settle(found.select("doc_id", "file", "row", "first", "n", "text_sha256", "d", "l", F.when(F.col("n") > 1, text).alias("text")), "hits")
    hits = rows.where("n > 1").withColumn("slot", F.pmod(F.xxhash64("file", "row"), F.ceil(F.col("n") / SPREAD)))
    is_first = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    content = hits.where(is_first).select(F.col("d").alias("cd"), F.col("l").alias("cl"), F.col("text").alias("content"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / SPREAD) - 1)).alias("cslot"))
    same_slot = (F.col("d") == F.col("cd")) & (F.col("l") == F.col("cl")) & (F.col("slot") == F.col("cslot"))
    differing = settle(hits.join(content, same_slot).where("text != content").select("d", "l").distinct(), "differing")
    placed = rows.select("doc_id", "file", "row", "first", "n", "text_sha256", "d", "l")
    if not differing.isEmpty():
        odd = rows.where("n > 1").join(differing, ["d", "l"], "left_semi")
        groups = odd.groupBy(F.col("d").alias("gd"), F.col("text").alias("same")).agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"))
        apart = odd.drop("first", "n").join(groups, (F.col("d") == F.col("gd")) & (F.col("text") == F.col("same"))).select(placed.columns)
        placed = placed.join(differing, ["d", "l"], "left_anti").select(placed.columns).union(apart)
    return placed.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), is_first.alias("kept"), "text_sha256")


def distinct_documents(spark: SparkSession, path: str, **how) -> DataFrame:
    """The ids that stay at deduplicate(), one row for each group; a null id where a group has no other. No rows: no rows."""
    return deduplicate(spark, path, **how).where("kept").select("doc_id")
