"""Queries over small repositories given as rows; their expected rows, written by hand, stand beside them as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import repository

WORKFLOW = {
    "src/backend/routes.ts": "app.get('/users', (req, res) => {\n  res.json([]);\n});\napp.post('/users', (req, res) => {\n  res.send(req.body.name + req.body.email);\n});\n",
    "src/frontend/api.ts": "export function loadUsers() {\n  return fetch('/users');\n}\nexport function loadOrders() {\n  return fetch('/order');\n}\nexport function saveUser(name) {\n  return axios.post('/users', { name: 'x' });\n}\naxios.delete('/users');\n",
    "src/backend/orders.ts": "router.get('/orders', list);\n",
    "src/utils/math.ts": "// one\n// two\n// three\nexport function add(a, b) {\n  return a + b;\n}\nexport function subtract(a, b) {\n  return a - b;\n}\n",
    "src/utils/consumer.ts": "import { add, subtract } from './math';\nimport gone from './gone';\nconsole.log(add(1, 2), gone);\nconst spare = 1;\n",
    "src/utils/math.spec.ts": "import { add } from './math';\nadd(1, 1);\n",
}


def _repo(spark: SparkSession) -> repository.Repository:
    return repository.Repository.of(spark.createDataFrame(list(WORKFLOW.items()), "path string, content string"))


def deadcode_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.dead_code(_repo(spark)).select("type", "path", "line", "confidence", "suggested_action")


def contract_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repository.contract(_repo(spark))
    rows = got["discrepancies"].select("category", "path", "line", "detail")
    rows = rows.unionByName(got["missing"].select(F.lit("missing").alias("category"), "path", "line", F.format_string("%s %s", "method", "url").alias("detail")))
    return rows.unionByName(got["unconsumed"].select(F.lit("unconsumed").alias("category"), "path", "line", F.format_string("%s %s", "method", "route").alias("detail")))


def references_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _repo(spark)
    used = repository.usages(repo).where("symbol_id LIKE '%math.ts%'").select("symbol_id", F.lit("usage").alias("kind"), "path", "line")
    return used.unionByName(repository.importers(repo).select("symbol_id", F.lit("import").alias("kind"), "path", "line"))


def warnings_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.code_warnings(_repo(spark)).select("type", "path", "start_line", "end_line")


def precommit_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _repo(spark)
    path = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    return repository.review(repo, path("src/utils/consumer.ts"), path("notes.ts"), repo.files).select("check", "severity", "path", "line")


def symbols_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repo(spark).symbols.select("id", "type", "line", "end_line")


def _literal(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of rows; a column may have a type after a colon, and is text or a whole number without one."""
    names = [c.strip().partition(":") for c in columns.split(",")]
    quoted = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    picked = ", ".join(f'CAST("{n}" AS {kind}) AS "{n}"' if kind else f'"{n}"' for n, _, kind in names)
    return f"SELECT {picked} FROM (VALUES {quoted}) AS t({', '.join(f'"{n}"' for n, _, _ in names)})"


SQL = {
    "deadcode_fixture": values('type, path, line, confidence, suggested_action', [
        ("unused-import", "src/utils/consumer.ts", 1, "alto", "eliminar"), ("unused-variable", "src/utils/consumer.ts", 4, "alto", "eliminar"),
        ("unused-function", "src/frontend/api.ts", 1, "alto", "eliminar"), ("unused-function", "src/frontend/api.ts", 4, "alto", "eliminar"), ("unused-function", "src/frontend/api.ts", 7, "alto", "eliminar"),
        *[("orphan-file", p, 1, "alto", "revisar-manualmente") for p in ("src/backend/routes.ts", "src/frontend/api.ts", "src/backend/orders.ts", "src/utils/consumer.ts")],
    ]),
    "contract_fixture": values("category, path, line, detail", [
        ("missing", "src/frontend/api.ts", 5, "GET /order"), ("unconsumed", "src/backend/orders.ts", 1, "GET /orders"), ("route-mismatch", "src/frontend/api.ts", 5, "GET /orders"),
        ("missing-field", "src/frontend/api.ts", 8, "email"), ("method-mismatch", "src/frontend/api.ts", 2, "POST /users"), ("method-mismatch", "src/frontend/api.ts", 8, "GET /users"),
        ("method-mismatch", "src/frontend/api.ts", 10, "GET /users"), ("method-mismatch", "src/frontend/api.ts", 10, "POST /users"),
    ]),
    "references_fixture": values("symbol_id, kind, path, line", [
        ("src/utils/math.ts#add@4", "import", "src/utils/consumer.ts", 1), ("src/utils/math.ts#subtract@7", "import", "src/utils/consumer.ts", 1), ("src/utils/math.ts#add@4", "import", "src/utils/math.spec.ts", 1),
        ("src/utils/math.ts#add@4", "usage", "src/utils/consumer.ts", 3), ("src/utils/math.ts#add@4", "usage", "src/utils/math.spec.ts", 2),
    ]),
    "warnings_fixture": values("type, path, start_line, end_line", [("commented-code", "src/utils/math.ts", 1, 3)]),
    "precommit_fixture": values('check, severity, path, line', [
        ("broken-imports", "error", "src/utils/consumer.ts", 2), ("forgotten-files", "recomendación", "notes.ts", 1), ("unused-code", "advertencia", "src/utils/consumer.ts", 1),
        ("unused-code", "advertencia", "src/utils/consumer.ts", 4), ("unused-code", "advertencia", "src/utils/consumer.ts", 1),
    ]),
    "symbols_fixture": values("id, type, line, end_line", [
        ("src/backend/routes.ts#GET /users@1", "endpoint", 1, 3), ("src/backend/routes.ts#POST /users@4", "endpoint", 4, 6), ("src/frontend/api.ts#loadUsers@1", "function", 1, 3), ("src/frontend/api.ts#loadOrders@4", "function", 4, 6),
        ("src/frontend/api.ts#saveUser@7", "function", 7, 9), ("src/backend/orders.ts#GET /orders@1", "endpoint", 1, 1), ("src/utils/math.ts#add@4", "function", 4, 6), ("src/utils/math.ts#subtract@7", "function", 7, 9),
    ]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (deadcode_fixture, contract_fixture, references_fixture, warnings_fixture, precommit_fixture, symbols_fixture)}
