"""The parse stage: files in, one row per file out, and the tables that unfold from it.

Rows of a file stay together until here; everything after is joins and aggregates. ``seq`` orders what a file holds; files
are ordered by path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test
from .lexer import Broken
from .units import Unit

_PARAMETER = "struct<name: string, type: string, required: boolean, source: string>"
_FIELD = "struct<name: string, type: string>"
UNIT = f"""path string, error string,
    symbols array<struct<id: string, name: string, type: string, line: int, column: int, end_line: int, parameters: array<{_PARAMETER}>, return_type: string, calls: array<string>>>,
    imports array<struct<source: string, specifiers: array<string>, is_default: boolean, line: int>>,
    exports array<struct<name: string, is_default: boolean, line: int>>,
    endpoints array<struct<route: string, method: string, line: int, parameters: array<{_PARAMETER}>, body: struct<type: string, properties: array<{_FIELD}>, required: array<string>>, response: string>>,
    calls array<struct<url: string, method: string, line: int, sent: struct<type: string, properties: array<{_FIELD}>>>>,
    variables array<struct<name: string, line: int>>, modules array<struct<source: string, line: int>>"""
_PARTS = ("symbols", "imports", "exports", "endpoints", "calls", "variables", "modules")
_OCCURRENCE = "path string, token string, offset int, line int, kind string, is_dynamic boolean"

#: One alternative per class of characters. Patterns between slashes aren't told from code, quotes run over line ends, and
#: code in a template is string: occurrences are judged so on purpose.
_CLASSES = re.compile(r"(?P<comment>//[^\n]*\n?|/\*.*?(?:\*/|\Z))|(?P<string>'(?:[^'\\]|\\.)*(?:'|\\?\Z)|\"(?:[^\"\\]|\\.)*(?:\"|\\?\Z)|`(?:[^`\\]|\\.)*(?:`|\\?\Z))", re.S)
_TOKEN = re.compile(r"[A-Za-z0-9_$]+")
#: Occurrences after which a frame is handed on.
FRAME = 100_000
#: Fixed value: characters around an occurrence that tell a dynamic use.
WINDOW = 60


def parse(path: str, text: str) -> dict:
    try:
        unit = Unit(path, text)
    except (Broken, RecursionError) as error:
        return {"path": path, "error": str(error)} | {p: [] for p in _PARTS}
    found = unit.record()
    for e in found["endpoints"]:
        e["response"] = None if e["response"] is None else json.dumps(e["response"])
        if e["body"]:
            e["body"]["properties"] = [{"name": p["name"], "type": p["type"]} for p in e["body"]["properties"]]
    return {"path": path, "error": None} | found


def units(files: DataFrame) -> DataFrame:
    """One row per file: path, error, and arrays of what it holds; a file that can't be parsed has an error alone, and so has
    one whose row has an error already, where there is such a column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = zip(pdf["path"], pdf["content"], pdf["error"], strict=True)
            yield pd.DataFrame([parse(p, t or "") if pd.isna(e) else {"path": p, "error": e} | {x: [] for x in _PARTS} for p, t, e in rows], columns=["path", "error", *_PARTS])

    error = F.col("error") if "error" in files.columns else F.lit(None)
    return files.select("path", "content", error.cast("string").alias("error")).mapInPandas(run, UNIT)


def unfold(parsed: DataFrame, part: str) -> DataFrame:
    """path, seq and the fields of one kind of thing."""
    return parsed.select("path", F.posexplode(part).alias("seq", "x")).select("path", "seq", "x.*")


def symbols(parsed: DataFrame) -> DataFrame:
    """Symbols, one per id: the last of equal ids, at the place of the first."""
    rows = unfold(parsed, "symbols")
    last = rows.groupBy("id").agg(F.min("seq").alias("first_seq"), F.max_by(F.struct(*rows.columns), "seq").alias("x"))
    return last.select("x.*", "first_seq").drop("seq").withColumnRenamed("first_seq", "seq")


def is_dynamic(text: str, at: int, name: str) -> bool:
    around = text[max(0, at - WINDOW) : at + len(name) + WINDOW]
    own = re.escape(name)
    bounded = rf"(?<![A-Za-z0-9_]){own}(?![A-Za-z0-9_])"
    return ("require" in around and bool(re.search(rf"require\s*\([^)]*{bounded}[^)]*\)", around))) or ("[" in around and bool(re.search(rf"\[\s*{own}\s*\]", around)))


def occurrences_of(path: str, text: str) -> list[tuple]:
    kinds = [(m.start(), m.end(), m.lastgroup) for m in _CLASSES.finditer(text)]
    out, k, line, last = [], 0, 1, 0
    for m in _TOKEN.finditer(text):
        at = m.start()
        while k < len(kinds) and kinds[k][1] <= at:
            k += 1
        kind = kinds[k][2] if k < len(kinds) and kinds[k][0] <= at else "code"
        line += text.count("\n", last, at)
        last = at
        out.append((path, m[0], at, line, kind, kind == "code" and is_dynamic(text, at, m[0])))
    return out


def occurrences(files: DataFrame) -> DataFrame:
    """Every token of every file: path, token, offset, line, kind (code, comment, string), is_dynamic."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, held = ["path", "token", "offset", "line", "kind", "is_dynamic"], []
        for pdf in frames:
            for p, t in zip(pdf["path"], pdf["content"], strict=True):
                held += occurrences_of(p, t or "")
                if len(held) >= FRAME:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
        yield pd.DataFrame(held, columns=columns)

    return files.select("path", "content").mapInPandas(run, _OCCURRENCE).withColumn("is_test", is_test(F.col("path")))
