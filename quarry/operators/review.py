"""A review before a commit: which checks run, what they find, and whether anything forbids the commit.

Nothing is executed here: outputs of tools, and which packages are installed, come as data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_secret, lines
from . import tools

#: Checks in order, file names that configure the linter, endings it looks at, and a test script that is none.
CHECKS = ["linter", "unit-tests", "compilation", "broken-imports", "forgotten-files", "unused-code", "secrets"]
LINTER_FILES = [".eslintrc", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.mjs", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml", "eslint.config.js", "eslint.config.cjs", "eslint.config.mjs", "eslint.config.ts"]
SOURCES, NO_TESTS = r"\.(js|jsx|ts|tsx)$", "no test specified"
#: Why a check is skipped.
REASONS = {
    "no linter config": "ESLint no está configurado (no se encontró archivo de configuración).", "no linter": "ESLint no está instalado en el proyecto.", "linter output": "No se pudo interpretar la salida del linter.",
    "no tests": 'No hay pruebas unitarias configuradas (no se encontró un script "test" en package.json).', "no runner": "El framework de pruebas (vitest) no está instalado.", "tests output": "No se pudo interpretar la salida de las pruebas unitarias.",
    "no tsconfig": "No se encontró tsconfig.json; no es posible compilar el proyecto.", "no compiler": "El compilador de TypeScript no está instalado.",
}
FINDING = "check string, severity string, path string, line int, description string"


def linter_configured(names: Column, manifest: Column) -> Column:
    """Whether a root folder's file names or its package.json configure the linter."""
    return F.arrays_overlap(names, F.array(*map(F.lit, LINTER_FILES))) | F.get_json_object(manifest, "$.eslintConfig").isNotNull()


def skipped(project: DataFrame) -> DataFrame:
    """check, reason of the checks that can't run. Input, one row: names, manifest (JSON), installed, has_staged_sources,
    linter_output, tests_output."""
    names, has = F.coalesce("names", F.array().cast("array<string>")), lambda p: F.array_contains(F.coalesce("installed", F.array().cast("array<string>")), p)
    legible = lambda c, kind: F.coalesce(F.startswith(F.ltrim(F.coalesce(c, F.lit(""))), F.lit(kind)) & F.try_parse_json(c).isNotNull(), F.lit(False))
    script = F.coalesce(F.get_json_object("manifest", "$.scripts.test"), F.lit(""))
    why = lambda *rules: F.coalesce(*[F.when(c, F.lit(REASONS[r])) for r, c in rules])
    linter = why(("no linter config", ~F.coalesce(linter_configured(names, F.col("manifest")), F.lit(False))), ("no linter", ~has("eslint")), ("linter output", F.col("has_staged_sources") & ~legible(F.col("linter_output"), "[")))
    tests = why(("no tests", (script == "") | F.contains(script, F.lit(NO_TESTS))), ("no runner", ~has("vitest")), ("tests output", ~legible(F.col("tests_output"), "{")))
    compilation = why(("no tsconfig", ~F.array_contains(names, "tsconfig.json")), ("no compiler", ~has("typescript")))
    rows = F.array(*[F.struct(F.lit(k).alias("check"), c.alias("reason")) for k, c in zip(CHECKS, (linter, tests, compilation))])  # noqa: B905
    return project.select(F.explode(rows).alias("r")).select("r.*").where("reason IS NOT NULL")


def tool_findings(project: DataFrame) -> DataFrame:
    """What linter, tests and compiler found, for the checks that aren't skipped. Input as skipped(), and compiler_output."""
    output = lambda rows, c: rows.select(F.col(c).alias("output"))
    found = [tools.lint(output(project.where("has_staged_sources"), "linter_output")), tools.tests(output(project, "tests_output")), tools.compilation(output(project, "compiler_output"))]
    return reduce(DataFrame.unionByName, found).join(skipped(project), "check", "left_anti")


def secrets(staged_files: DataFrame) -> DataFrame:
    """path, line of lines of staged files (path, content) that hold a secret."""
    rows = staged_files.select("path", F.posexplode(lines(F.col("content"))).alias("at", "text"))
    return rows.where(has_secret(F.col("text"))).select("path", (F.col("at") + 1).cast("int").alias("line"))


def secret_findings(found: DataFrame, pattern: str = "secret") -> DataFrame:
    """Findings of secrets, without a confidence. Input: path, line."""
    return found.select(F.lit("precommit:secret").alias("type"), F.lit("pre-commit-reviewer").alias("source_module"), "path", "line", F.lit(f"Posible secreto detectado ({pattern}).").alias("description"))


def statuses(skips: DataFrame, unfinished: list[str] | None = None) -> DataFrame:
    """check, status, reason: each check in order, completed, skipped or, where time ran out, incomplete."""
    spark, late = skips.sparkSession, set(unfinished or [])
    every = spark.createDataFrame([(i, c, c in late) for i, c in enumerate(CHECKS)], "ord int, check string, late boolean")
    rows = every.join(skips, "check", "left")
    status = F.when(F.col("late"), "incomplete").when(F.col("reason").isNotNull(), "skipped").otherwise("completed")
    return rows.select("ord", "check", status.alias("status"), F.when(~F.col("late"), F.col("reason")).alias("reason"))


def has_errors(findings: DataFrame, found_secrets: DataFrame) -> DataFrame:
    """One row, has_errors: whether any finding is an error or any secret was found."""
    marks = findings.select((F.col("severity") == "error").alias("bad")).unionByName(found_secrets.select(F.lit(True).alias("bad")))
    return marks.agg(F.coalesce(F.bool_or("bad"), F.lit(False)).alias("has_errors"))
