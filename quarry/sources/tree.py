"""A tree of files as tables: a listing by planned folders, then contents, with an error row for each file that can't be read.

The driver goes down from the root until there are enough folders to deal out; tasks list what lies below. Paths are
filtered natively before a file is opened. Stores are those that pyarrow reaches by the root's URI, the same on all machines.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.paths import DEPENDENCY_FOLDERS
from .tables import Workspace, delete

LISTED = "path string, size long, modification_time timestamp"
CONTENT = "path string, content string, modification_time timestamp, error string"
#: How many parts a listing is dealt into; bytes of files, and number of files, that one task reads; bytes held before a batch
#: is handed on.
FOLDERS, TASK_BYTES, TASK_FILES, BATCH_BYTES = 256, 256 << 20, 5_000, 32 << 20
#: What a text column can hold of one file.
LARGEST = (1 << 31) - 1
_ROWS = 10_000


@dataclass
class Folders(InputPartition):
    """Folders that one task lists: path, and whether what lies below is listed too."""

    folders: list[tuple[str, bool]]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and the folder's path in it."""
    store, path = fs.FileSystem.from_uri(uri)
    return store, path.rstrip("/")


def entries(store: fs.FileSystem, folder: str) -> tuple[list[fs.FileInfo], list[str]]:
    """Files of a folder, and folders in it that are entered: no folders of dependencies, no links. None of a folder that
    can't be listed."""
    try:
        found = store.get_file_info(fs.FileSelector(folder))
    except OSError:
        return [], []
    if isinstance(store, fs.LocalFileSystem):
        found = [x for x in found if not os.path.islink(x.path)]
    return [x for x in found if x.type == fs.FileType.File], sorted(x.path for x in found if x.type == fs.FileType.Directory and x.base_name not in DEPENDENCY_FOLDERS)


def planned(store: fs.FileSystem, root: str, parts: int) -> list[Folders]:
    """At most ``parts`` partitions. At most as many folders are listed here, those nearest to the root."""
    alone, whole = [], [root]
    while whole and len(alone) < parts and len(whole) < parts:
        alone.append(whole.pop(0))
        whole += entries(store, alone[-1])[1]
    work = [(x, True) for x in whole] + [(x, False) for x in alone]
    return [Folders(work[i::parts]) for i in range(min(parts, len(work)))]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.parts = options["path"], int(options.get("parts", FOLDERS))

    def partitions(self) -> list[InputPartition]:
        return planned(*opened(self.root), self.parts)

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.root)
        todo, held = list(partition.folders), []
        while todo:
            folder, deep = todo.pop()
            files, below = entries(store, folder)
            todo += [(x, True) for x in below] if deep else []
            held += [(x.path[len(root) + 1 :], x.size, x.mtime) for x in files]
            while len(held) >= _ROWS:
                yield self._batch(held[:_ROWS])
                held = held[_ROWS:]
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["path", "size", "modification_time"])


class Tree(DataSource):
    """Format ``file_tree``: relative path, size and time of every file below ``path``; option ``parts``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def listing(spark: SparkSession, root: str, parts: int = FOLDERS) -> DataFrame:
    """path (relative), size, modification_time of every file below a folder; none where there is no such folder."""
    spark.dataSource.register(Tree)
    return spark.read.format("file_tree").option("parts", parts).load(root)


def _reading(root: str, held_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def text_of(store: fs.FileSystem, path: str) -> str:
        with store.open_input_stream(path) as stream:
            data = stream.read(LARGEST + 1)
        text = data.decode("utf-8", "replace")
        if len(data) > LARGEST or (len(text) != len(data) and len(text.encode()) > LARGEST):
            raise OSError("the file is larger than a text can be")
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        for batch in batches:
            begin, held, texts, errors = 0, 0, [], []

            def flush() -> pa.RecordBatch:
                nonlocal begin, held, texts, errors
                some = batch.slice(begin, len(texts))  # noqa: B023
                out = pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string()), some.column(1), pa.array(errors, pa.string())], names=["path", "content", "modification_time", "error"])
                begin, held, texts, errors = begin + len(texts), 0, [], []
                return out

            for path in batch.column(0).to_pylist():
                text = error = None
                try:
                    text = text_of(store, f"{top}/{path}")
                except OSError as failed:
                    error = f"{type(failed).__name__}: {failed}"
                if texts and held + len(text or "") > held_bytes:
                    yield flush()
                texts.append(text)
                errors.append(error)
                held += len(text or "")
            if texts:
                yield flush()

    return run


def contents(files: DataFrame, root: str, task_bytes: int = TASK_BYTES, batch_bytes: int = BATCH_BYTES, task_files: int = TASK_FILES) -> DataFrame:
    """path, content, modification_time, error of listed files, read from whole files as UTF-8; what isn't gets a
    replacement character. A file that is gone, barred, or too large for a text has an error and no content. Small files take
    their time by number and not by bytes, so tasks are dealt by both.

    ``files`` is read twice, for its bytes and for its names: a listing that may change is settled before.
    """
    total, number = files.agg(F.sum("size"), F.count(F.lit(1))).first()
    tasks = max((total or 0) // task_bytes, number // task_files) + 1
    dealt = files.select("path", "modification_time").repartition(tasks, "path")
    return dealt.mapInArrow(_reading(root, batch_bytes), CONTENT)


def scan(spark: SparkSession, root: str, wanted: Callable | None = None, parts: int = FOLDERS) -> DataFrame:
    """contents() of the files whose path is wanted, by one listing that is kept as a table."""
    files = listing(spark, root, parts)
    if wanted is not None:
        files = files.where(wanted(F.col("path")))
    return contents(Workspace(spark, "listing").settle(files), root)


def _writing(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        made: set[str] = set()
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{top}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                # a task may run twice, also at once: each attempt writes a file of its own, which then takes the name
                own = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write((text or "").encode())
                store.move(own, f"{top}/{path}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    return run


def write(files: DataFrame, root: str) -> int:
    """Write path and content of each row as a file below ``root``; tells how many rows there were. Null content is an empty
    file, rows without a path are left out; of rows with one path, any is what stays."""
    return files.where("path IS NOT NULL").select("path", "content").mapInArrow(_writing(root), "path string").agg(F.count("path")).first()[0]


def _removing(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    store.delete_file(f"{top}/{path}")
                except OSError:  # gone already, or never written: what is left goes with the folder
                    pass
            yield batch

    return run


def remove(files: DataFrame, root: str) -> None:
    """Delete a folder with all that is in it; the files whose path is named go by tasks before, side by side."""
    files.where("path IS NOT NULL").select("path").mapInArrow(_removing(root), "path string").agg(F.count("path")).first()
    delete(files.sparkSession, root)
