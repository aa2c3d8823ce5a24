"""Token ids of documents in files of packed integers, in the order of document ids."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, settle
from .pfor import Packed, pack
from .tokenizers_io import word_encoder

#: Values after which a file ends; one document is never split.
FILE_VALUES = 1 << 21


def _writer(folder: str, tokenizer: str, end_id: int | None, file_values: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, seq, encoder = TaskContext.get().partitionId(), 0, word_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        coded: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, coded, held
            name = f"part-{part:06d}-{seq:06d}.pfor"
            data = pack(ids, [len(x) // 4 for x in coded], np.frombuffer(b"".join(coded), "<u4"))
            # a task may run twice, also at once: each attempt writes its own file, and equal contents take the name
            own = f"{root}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(data)
            store.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(ids)], "n_values": [held]})
            seq, ids, coded, held = seq + 1, [], [], 0
            return row

        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                coded.append(got + end)
                ids.append(doc_id)
                held += len(coded[-1]) // 4
                if held >= file_values:
                    yield flush()
        if ids:
            yield flush()

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, file_values: int = FILE_VALUES) -> DataFrame:
    """Write the ids of every whole text to files in ``folder``; returns the manifest: name, n_docs, n_values, start.

    Documents are dealt into ranges of ids, so that names sort as ids do. ``start`` is the number of values in all files
    before. Null text counts as empty; a null id comes first and is kept as null; equal ids are ordered by text.
    """
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = settle(ranged.mapInArrow(_writer(folder, tokenizer, end_id, file_values), "name string, n_docs long, n_values long"), "manifest")
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_values").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            file = Packed(content.as_py())
            values = memoryview(file.values().astype("<u4", copy=False)).cast("B")
            ends = np.cumsum(file.lengths, dtype=np.int64)
            begins = ends - file.lengths
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path.rsplit("/", 1)[-1]] * n), pa.array(file.doc_ids, pa.int64()), pa.array(begins), pa.array(file.lengths.astype(np.int64)), pa.array([zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())],
                names=["file", "doc_id", "begin", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    rows = files.mapInArrow(_read, "file string, doc_id long, begin long, n_tokens long, ids_crc32 long")
    at = manifest.select("name", F.col("start").alias("file_start"))
    return rows.join(at, F.col("file") == F.col("name")).select("doc_id", (F.col("file_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", "file")


def token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, file_values: int = FILE_VALUES) -> DataFrame:
    """write_tokens() and read_tokens(): what the files hold, one row per document. No rows: no files, no rows."""
    spark = docs.sparkSession
    manifest = write_tokens(docs, folder, tokenizer, end_id, file_values)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    return read_tokens(spark, folder, manifest)
