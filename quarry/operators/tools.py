"""Findings from the output of a linter, a test runner, a compiler and a language model. Input: one text column, output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines

_LINT = "array<struct<filePath: string, messages: array<struct<severity: int, line: int, message: string, ruleId: string>>>>"
_TESTS = "struct<testResults: array<struct<name: string, assertionResults: array<struct<status: string, fullName: string, failureMessages: array<string>, location: struct<line: int>>>>>>"
_MATCHES = "array<struct<symbolName: string, filePath: string, explanation: string>>"


def _finding(rows: DataFrame, check: str, severity, path, line, text) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), severity.alias("severity"), path.alias("path"), line.alias("line"), text.alias("description"))


def lint(output: DataFrame) -> DataFrame:
    files = output.select(F.explode(F.from_json("output", _LINT)).alias("f"))
    m = files.select("f.filePath", F.explode("f.messages").alias("m")).select("filePath", "m.*")
    line = F.when(F.coalesce("line", F.lit(0)) == 0, 1).otherwise(F.col("line"))
    text = F.when(F.coalesce("ruleId", F.lit("")) != "", F.concat("message", F.lit(" ("), "ruleId", F.lit(")"))).otherwise(F.col("message"))
    return _finding(m, "linter", F.when(F.col("severity") >= 2, "error").otherwise("advertencia"), F.col("filePath"), line, text)


def tests(output: DataFrame) -> DataFrame:
    files = output.select(F.explode(F.from_json("output", _TESTS)["testResults"]).alias("f"))
    a = files.select("f.name", F.explode("f.assertionResults").alias("a")).select("name", "a.*").where("status = 'failed'")
    text = F.coalesce(F.nullif(F.array_join("failureMessages", " "), F.lit("")), F.format_string('Falló la prueba "%s".', F.coalesce("fullName", F.lit(""))))
    return _finding(a, "unit-tests", F.lit("error"), F.col("name"), F.coalesce("location.line", F.lit(1)), text)


def compilation(output: DataFrame) -> DataFrame:
    pattern = r"^(.+?)\((\d+),(\d+)\): error (TS\d+): (.+)$"
    rows = output.select(F.explode(lines(F.col("output"))).alias("x")).where(F.col("x").rlike(pattern))
    part = lambda i: F.regexp_extract("x", pattern, i)
    line = F.greatest(part(2).cast("int"), F.lit(1))
    return _finding(rows, "compilation", F.lit("error"), part(1), line, F.concat(part(4), F.lit(": "), part(5)))


def untracked(output: DataFrame) -> DataFrame:
    """path of the lines of a short status that begin with two question marks."""
    rows = output.select(F.explode(lines(F.col("output"))).alias("x")).where(F.startswith("x", F.lit("??")))
    return rows.select(F.trim(F.substring("x", 3, 1 << 30)).alias("path"))


def model_matches(output: DataFrame, candidates: DataFrame) -> DataFrame:
    """at, name, path, explanation: what a model's answer names among the candidates (name, path), in its order.

    Code fences around the answer are ignored; what isn't a JSON array gives no rows.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim("output"), r"(?i)^```(?:json)?", ""), r"```$", "")
    found = output.select(F.posexplode(F.from_json(F.trim(bare), _MATCHES)).alias("at", "m")).where("m.symbolName IS NOT NULL AND m.filePath IS NOT NULL")
    rows = found.select("at", F.col("m.symbolName").alias("name"), F.col("m.filePath").alias("path"), F.coalesce("m.explanation", F.lit("")).alias("explanation"))
    return rows.join(candidates.select("name", "path").distinct(), ["name", "path"], "left_semi")
