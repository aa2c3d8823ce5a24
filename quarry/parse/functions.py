"""The parse stage as table functions, for SQL and for DataFrames.

Each takes a table with ``path`` and ``content``, as ``char_classes(TABLE(files))``. Rows are taken a batch at a time where
they lie: without PARTITION BY nothing is shuffled. Null content is an empty text. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tables

#: Rows of a frame; a file's rows may go on in the next one, so that long texts don't make long frames.
ROWS = 100_000
CLASSES = "path string, kind string, start int, length int"
OCCURRENCES = "path string, token string, offset int, line int, kind string, is_dynamic boolean"
SYMBOLS = "path string, seq int, id string, name string, type string, line int, error string"
_OPENING = {"//": "line-comment", "/*": "block-comment", "'": "single", '"': "double", "`": "template"}


def runs_of(path: str | None, text: str) -> Iterator[tuple]:
    """path, kind, start and length of each run of characters of one class, in order, without gaps."""
    last = 0
    for m in tables._CLASSES.finditer(text):
        if m.start() > last:
            yield path, "code", last, m.start() - last
        kind = _OPENING.get(m[0][:2]) or _OPENING[m[0][0]]
        yield path, kind, m.start(), m.end() - m.start()
        last = m.end()
    if len(text) > last:
        yield path, "code", last, len(text) - last


def symbols_of(path: str, text: str) -> Iterator[tuple]:
    """Symbols in the order in which they stand; one row with an error for a text that can't be parsed."""
    found = tables.parse(path, text)
    if found["error"] is not None:
        yield path, None, None, None, None, None, found["error"]
    for seq, s in enumerate(found["symbols"]):
        yield path, seq, s["id"], s["name"], s["type"], s["line"], None


def framed(files: Iterator[tuple[str | None, str | None]], rows_of, names: list[str], types: list[pa.DataType], most: int) -> Iterator[pa.Table]:
    """Rows of many files in frames of ``most`` rows; the last frame has what is left."""
    columns: list[list] = [[] for _ in names]

    def flush() -> pa.Table:
        frame = pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        for c in columns:
            c.clear()
        return frame

    for path, text in files:
        for row in rows_of(path, text or ""):
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            if len(columns[0]) >= most:
                yield flush()
    if columns[0]:
        yield flush()


def _function(rows_of, schema: str, most: int = ROWS):
    fields = StructType.fromDDL(schema).fields
    names, types = [f.name for f in fields], [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in fields]

    class Function:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            paths = batch.column(batch.schema.get_field_index("path")).cast(pa.string()).to_pylist()
            texts = batch.column(batch.schema.get_field_index("content")).to_pylist()
            yield from framed(zip(paths, texts, strict=True), rows_of, names, types, most)

    return F.arrow_udtf(Function, returnType=schema)


def register(spark: SparkSession) -> None:
    """Make char_classes, token_occurrences and file_symbols known to SQL."""
    for name, rows_of, schema in (("char_classes", runs_of, CLASSES), ("token_occurrences", tables.occurrences_of, OCCURRENCES), ("file_symbols", symbols_of, SYMBOLS)):
        spark.udtf.register(name, _function(rows_of, schema))
