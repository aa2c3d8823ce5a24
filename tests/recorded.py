"""Operators over small inputs given as rows. What they gave stands below: a change shows, a fault that was there doesn't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import events as ex
from quarry.functions import findings as fx
from quarry.functions import text as tx
from quarry.operators import fixes, graph, manifest, search, tools
from quarry.operators import review as review_ops
from quarry.sources.repository import manifest as read_manifest
from quarry.streaming import index, seeds
from quarry.plans import repository

from .handwritten import _repo, values

PACKAGE = '{"name": "demo", "description": "Una demo.", "scripts": {"dev": "vite", "test": "vitest"}, "dependencies": {"react": "1", "express": "2", "left": "3"}, "devDependencies": {"typescript": "5"}}'
LINT = '[{"filePath": "a.ts", "messages": [{"severity": 2, "line": 3, "message": "m", "ruleId": "r"}, {"severity": 1, "message": "n", "ruleId": null}]}]'
TESTS = '{"testResults": [{"name": "t.ts", "assertionResults": [{"status": "passed"}, {"status": "failed", "fullName": "x", "failureMessages": []}]}]}'
PROJECT = "names array<string>, manifest string, installed array<string>, has_staged_sources boolean, linter_output string, tests_output string, compiler_output string"
CODE = {
    "ui.tsx": "import React, { useState as useLocal } from 'react';\nexport default class Panel extends React.Component {\n  draw(level: number): string {\n    return label(level);\n  }\n}\nexport const Card = (props) => <div>{props.x}</div>;\nfunction label(n) { return `${n}`; }\nexport const useUser = () => { return fetch(`/users/${1}`); };\n",
    "api.js": "const router = require('express').Router();\nrouter.get('/items/:id', show);\nfunction show(req, res) { res.json({ id: req.params.id, full: req.query.full }); }\naxios({ method: 'put', url: '/items/1', data: { name: 'x', size: 2 } });\nfetch('/items', { method: 'POST', body: JSON.stringify({ on: true }) });\n",
}


def _code(spark: SparkSession) -> repository.Repository:
    return repository.Repository.of(spark.createDataFrame(list(CODE.items()), "path string, content string"))


def _project(spark: SparkSession) -> DataFrame:
    every = ["eslint", "vitest", "typescript"]
    rows = [([".eslintrc.json", "tsconfig.json"], PACKAGE, every, True, LINT, TESTS, "src/a.ts(4,2): error TS2304: Cannot find x.")]
    return spark.createDataFrame(rows, PROJECT)


def extraction_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark).symbols.select("id", "type", F.array_join(F.transform("parameters", lambda p: p["name"]), ",").alias("parameters"), "return_type", F.array_join("calls", ",").alias("calls"))


def exports_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _code(spark)
    return graph.export_graph(repo.files, repo.part("exports")).select("path", F.array_join("names", ",").alias("names"))


def calls_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = F.array_join(F.transform("sent.properties", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",")
    return _code(spark).part("calls").select("path", "line", "method", "url", sent.alias("sent"))


def endpoint_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["source"], p["required"].cast("string"))), ",")
    return _code(spark).part("endpoints").select("path", "line", "method", "route", params.alias("parameters"))


def callees_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.callees(_code(spark))


def dependents_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependents(repository.importers(_repo(spark)))


def lookup_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _repo(spark).symbols
    return graph.symbol_at(s, "add").unionByName(graph.symbol_at(s, "saveUser", "src/frontend/api.ts", 7)).unionByName(graph.symbol_at(s, "add", line=1)).select("id")


def search_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repository.search_results(_repo(spark), "ADD")
    return rows.select("path", "name", "type", "line", "snippet", F.array_join(F.transform("related", lambda r: F.concat_ws(":", r["relation"], r["related"])), ",").alias("related"))


class _Stub:
    """A model that names one real symbol and one that it made up."""

    def available(self) -> bool:
        return True

    def query(self, prompt: str) -> str:
        return '```json\n[{"symbolName": "made up", "filePath": "x"}, {"symbolName": "subtract", "filePath": "src/utils/math.ts", "explanation": "resta"}]\n```'


def semantic_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.search_results(_repo(spark), "subtract load", _Stub()).select("path", "name", "line", "explanation")


def prompt_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "g", "b.ts", "function", "y"), (0, "f", "a.ts", "class", "x")], "at int, name string, path string, type string, snippet string")
    parts = F.split("prompt", "\n\n")
    return search.prompt(rows, "q").select(F.posexplode(parts).alias("at", "part")).where("at BETWEEN 1 AND 4 AND at <> 2").select("at", "part")


def index_result_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("a.ts", "const a = 1;"), ("b.ts", "function ( {")], "path string, content string")
    return repository.index_result(repository.Repository.of(files))


def incremental_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("a.ts", "1"), ("b.ts", "2"), ("c.ts", "3")], "path string, content string")
    changes = [(1, "a.ts", "modify", "4"), (2, "b.ts", "delete", None), (3, "dist/d.js", "create", "no"), (4, "e.md", "create", "no"), (5, "f.ts", "create", "5"), (6, "a.ts", "modify", "6"), (7, ".env.ts", "create", "no")]
    return index.applied(files, spark.createDataFrame(changes, index.CHANGE), "dist/")


def review_checks_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = spark.createDataFrame([([], "{}", [], True, None, None, None)], PROJECT)
    return review_ops.statuses(review_ops.skipped(bare), ["secrets"])


def review_tools_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_ops.tool_findings(_project(spark))


def review_errors_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review_ops.tool_findings(_project(spark))
    files = spark.createDataFrame([("a.ts", "x\npassword = 'abcdefgh'\n"), ("b.ts", "y")], "path string, content string")
    held = review_ops.secrets(files)
    case = lambda name, f, s: review_ops.has_errors(f, s).select(F.lit(name).alias("case"), "has_errors")
    warned = found.where("severity <> 'error'")
    return case("error", found, held.limit(0)).unionByName(case("warning", warned, held.limit(0))).unionByName(case("secret", warned, held))


def secret_findings_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_ops.secret_findings(spark.createDataFrame([("a.ts", 2)], "path string, line int"), "token")


def untracked_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.untracked(spark.createDataFrame([("?? new.ts\n M old.ts\n?? b/c.ts\n",)], "output string"))


def fixes_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("a.ts", "one\n  two\nthree"), ("o.ts", "x")], "path string, content string")
    rows = [("unused-import", "a.ts", 1, "eliminar"), ("unused-function", "a.ts", 2, "comentar"), ("unused-variable", "a.ts", 9, "eliminar"), ("orphan-file", "o.ts", 1, "eliminar"), ("orphan-file", "a.ts", 1, "comentar"), ("unused-import", "a.ts", 3, "revisar-manualmente")]
    found = spark.createDataFrame([(*r[:3], "d", r[3]) for r in rows], "type string, path string, line int, description string, suggested_action string")
    done = fixes.outcomes(fixes.proposals(found, files).withColumn("confirmed", F.col("type") != "unused-import"), files)
    after = fixes.fixed_files(files, done).select(F.lit("file").alias("kind"), "path", F.lit(None).cast("int").alias("line"), F.col("content").alias("text"))
    return done.select(F.col("outcome").alias("kind"), "path", "line", F.col("preview").alias("text")).unionByName(after)


def readme_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _repo(spark)
    one = read_manifest(spark.createDataFrame([(PACKAGE,)], "content string"))
    env = spark.createDataFrame([("PORT",), ("HOST",)], "name string")
    return manifest.readme_sections(one, repo.files.where("path LIKE '%utils%'"), repo.part("endpoints"), env, "yarn").select("ord", "title", "content")


def explain_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = read_manifest(spark.createDataFrame([('{"dependencies": {"react": "1", "lodash": "2"}, "devDependencies": {"vitest": "1"}}',)], "content string"))
    none = _repo(spark)
    now = manifest.explanation(one, none.symbols, none.part("endpoints").limit(0))
    before = manifest.explanation(one.withColumn("dependencies", F.map_filter("dependencies", lambda k, v: k != "lodash")), none.symbols, none.part("endpoints").limit(0), "a b").select(F.struct("*").alias("before"))
    both = now.withColumn("now", F.struct(*now.columns)).withColumn("k", F.lit(1)).join(before.withColumn("k", F.lit(1)), "k")
    joined = lambda c: F.array_join(c, ",")
    return both.select(joined("frontend").alias("frontend"), joined("backend").alias("backend"), joined("dependencies").alias("dependencies"), "flow_failed", joined(F.transform("omitted", lambda o: o["title"])).alias("omitted"), joined(manifest.changed_parts(F.col("before"), F.col("now"))).alias("changed"))


def flow_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _code(spark)
    return manifest.flow_items(repo.symbols, repo.part("endpoints"))


def manager_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, ["pnpm-lock.yaml", "yarn.lock"]), (2, ["yarn.lock"]), (3, ["package-lock.json"])], "id int, names array<string>")
    return rows.select("id", manifest.package_manager(F.col("names")).alias("manager"))


def bus_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "indexing:started", "{}"), (2, "indexing:progress", '{"current": 1, "total": 4, "currentFile": "a.ts"}'), (3, "indexing:completed", '{"filesIndexed": 4}'), (4, "seed:created", "{}"), (5, "precommit:completed", '{"hasErrors": true}'),
        (6, "analysis:finding", '{"type": "dead-code:x", "filePath": "a.ts", "description": "d"}'), (7, "seed:updated", "{}"), (8, "indexing:completed", "{}")]
    made = seeds.event_stream(spark.createDataFrame(rows, "seq long, type string, payload string"))
    return made.select("seq", "event", ex.valid_event(F.col("event")).alias("valid"))


def actions_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, '{"action":"analyze-repository"}'), (2, '{"action":"mute-messages"}'), (3, '{"action":"dance"}'), (4, "no"), (5, '{"action":"close-mascot"}')], "id int, j string")
    return rows.select("id", ex.parsed_action(F.col("j")).alias("action"), ex.effect(ex.parsed_action(F.col("j"))).alias("effect"))


def seed_texts_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("s1", "tip", "d", "a.ts", 3, "eliminar", "Pendiente", True, "Resuelta"), ("s2", "problema", "e", None, None, None, "En revisión", True, "Pendiente"), ("s3", "tip", "f", None, None, "", "Resuelta", True, "Ignorada"), ("s4", "tip", "g", None, None, None, "Pendiente", False, "Ignorada")],
        "id string, type string, description string, path string, line int, action string, state string, known boolean, to string")
    c = F.col
    return rows.select("id", fx.seed_detail(c("type"), c("description"), c("path"), c("line"), c("action")).alias("detail"), F.array_join(F.transform(fx.buttons(c("state")), lambda b: b["label"]), ",").alias("buttons"), fx.transition_error(c("id"), c("known"), c("state"), c("to")).alias("error"))


def windows_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = [(0.0, 0.0, 100.0, 50.0), (100.0, 0.0, 10.0, 10.0)]
    rows = spark.createDataFrame([(1, 0.0, 0.0, area), (2, 100.0, 20.0, area), (3, 109.0, 9.0, area), (4, float("nan"), 1.0, area), (5, 110.0, 1.0, area)], "id int, x double, y double, areas array<struct<x: double, y: double, width: double, height: double>>")
    return rows.select("id", fx.within_any(F.col("x"), F.col("y"), F.col("areas")).alias("inside"))


def texts_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("  a<b & \"c\"", "data: x\ndata:y\n\nid: 1\n\ndata: open", ("object", [("a", "number"), ("b", "string")])), ("'", "", ("array", None))], "t string, s string, schema struct<type: string, properties: array<struct<name: string, type: string>>>")
    return rows.select("t", tx.html_escaped(F.col("t")).alias("escaped"), tx.commented_out(F.col("t")).alias("commented"), F.array_join(tx.sse_frames(F.col("s")), "|").alias("frames"), fx.schema_text(F.col("schema")).alias("schema"))


def animations_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("m", 0, 1, "idle"), ("m", 100, 2, "celebration"), ("m", 200, 3, "perch-on-file"), ("m", 9000, 4, "analysis-complete")]
    return seeds.animations(spark.createDataFrame(rows, "mascot string, at long, seq int, animation string"))


_QUERIES = (
    extraction_fixture, exports_fixture, calls_fixture, endpoint_fixture, callees_fixture, dependents_fixture, lookup_fixture, search_fixture, semantic_fixture, prompt_fixture, index_result_fixture, incremental_fixture,
    review_checks_fixture, review_tools_fixture, review_errors_fixture, secret_findings_fixture, untracked_fixture, fixes_fixture, readme_fixture, explain_fixture, flow_fixture, manager_fixture,
    bus_fixture, actions_fixture, seed_texts_fixture, windows_fixture, texts_fixture, animations_fixture,
)


#: Expected rows: recorded from a run, then read against the rules of each operator. They keep results as they are; they are no second opinion.
SQL = {
    "extraction_fixture": values("id, type, parameters, return_type, calls", [
        ('api.js#GET /items/:id@2', 'endpoint', None, None, ''),
        ('api.js#show@3', 'function', 'req,res', None, 'json'),
        ('ui.tsx#Card@7', 'component', 'props', None, ''),
        ('ui.tsx#Panel.draw@3', 'function', 'level', 'string', 'label'),
        ('ui.tsx#Panel@2', 'component', None, None, ''),
        ('ui.tsx#label@8', 'function', 'n', None, ''),
        ('ui.tsx#useUser@9', 'function', '', None, 'fetch'),
    ]),
    "exports_fixture": values("path, names", [
        ('api.js', ''),
        ('ui.tsx', 'Panel,Card,useUser'),
    ]),
    "calls_fixture": values("path, line:int, method, url, sent", [
        ('api.js', 4, 'PUT', '/items/1', 'name:string,size:number'),
        ('api.js', 5, 'POST', '/items', 'on:boolean'),
        ('ui.tsx', 9, 'GET', '/users/${1}', None),
    ]),
    "endpoint_fixture": values("path, line:int, method, route, parameters", [
        ('api.js', 2, 'GET', '/items/:id', 'id:route:true,full:query:false'),
    ]),
    "callees_fixture": values("symbol_id, callee_id", [
        ('ui.tsx#Panel.draw@3', 'ui.tsx#label@8'),
    ]),
    "dependents_fixture": values("symbol_id, path", [
        ('src/utils/math.ts#add@4', 'src/utils/consumer.ts'),
        ('src/utils/math.ts#add@4', 'src/utils/math.spec.ts'),
        ('src/utils/math.ts#subtract@7', 'src/utils/consumer.ts'),
    ]),
    "lookup_fixture": values("id", [
        ('src/frontend/api.ts#saveUser@7',),
        ('src/utils/math.ts#add@4',),
    ]),
    "search_fixture": values("path, name, type, line:int, snippet, related", [
        ('src/utils/math.ts', 'add', 'function', 4, 'export function add(a, b) {\n  return a + b;\n}\nexport function subtract(a, b) {\n  return a - b;\n}\n', 'imported-by:src/utils/consumer.ts,imported-by:src/utils/math.spec.ts'),
    ]),
    "semantic_fixture": values("path, name, line:int, explanation", [
        ('src/utils/math.ts', 'subtract', 7, 'resta'),
    ]),
    "prompt_fixture": values("at:int, part", [
        (1, 'Consulta del usuario: "q"'),
        (3, '1. symbolName: "f", filePath: "a.ts", type: "class"\nx'),
        (4, '2. symbolName: "g", filePath: "b.ts", type: "function"\ny'),
    ]),
    "index_result_fixture": values("total_files:bigint, files_processed:bigint, errors:bigint", [
        (2, 1, 1),
    ]),
    "incremental_fixture": values("path, content", [
        ('a.ts', '6'),
        ('c.ts', '3'),
        ('f.ts', '5'),
    ]),
    "review_checks_fixture": values("ord:int, check, status, reason", [
        (0, 'linter', 'skipped', 'ESLint no está configurado (no se encontró archivo de configuración).'),
        (1, 'unit-tests', 'skipped', 'No hay pruebas unitarias configuradas (no se encontró un script "test" en package.json).'),
        (2, 'compilation', 'skipped', 'No se encontró tsconfig.json; no es posible compilar el proyecto.'),
        (3, 'broken-imports', 'completed', None),
        (4, 'forgotten-files', 'completed', None),
        (5, 'unused-code', 'completed', None),
        (6, 'secrets', 'incomplete', None),
    ]),
    "review_tools_fixture": values("check, severity, path, line:int, description", [
        ('compilation', 'error', 'src/a.ts', 4, 'TS2304: Cannot find x.'),
        ('linter', 'advertencia', 'a.ts', 1, 'n'),
        ('linter', 'error', 'a.ts', 3, 'm (r)'),
        ('unit-tests', 'error', 't.ts', 1, 'Falló la prueba "x".'),
    ]),
    "review_errors_fixture": values("case, has_errors:boolean", [
        ('error', True),
        ('secret', True),
        ('warning', False),
    ]),
    "secret_findings_fixture": values("type, source_module, path, line:int, description", [
        ('precommit:secret', 'pre-commit-reviewer', 'a.ts', 2, 'Posible secreto detectado (token).'),
    ]),
    "untracked_fixture": values("path", [
        ('b/c.ts',),
        ('new.ts',),
    ]),
    "fixes_fixture": values("kind, path, line:int, text", [
        ('applied', 'a.ts', 2, '-   two\n+   // two'),
        ('applied', 'o.ts', 1, '- (archivo completo)\n+ (el archivo "o.ts" será eliminado)'),
        ('error', 'a.ts', 9, '- \n+ (línea eliminada)'),
        ('file', 'a.ts', None, 'one\n  // two\nthree'),
        ('rejected', 'a.ts', 1, '- one\n+ (línea eliminada)'),
    ]),
    "readme_fixture": values("ord:int, title, content", [
        (1, 'Descripción del proyecto', 'demo. Una demo. Contiene 3 archivo(s) indexado(s). Tecnologías detectadas: React (frontend), Express (backend), TypeScript.'),
        (2, 'Stack tecnológico', '- React (frontend)\n- Express (backend)\n- TypeScript\n- Otras dependencias: left'),
        (3, 'Instalación', '```bash\nyarn install\n```'),
        (4, 'Variables de entorno', '- `HOST`\n- `PORT`'),
        (5, 'Scripts disponibles', '- `npm run dev`: vite\n- `npm run test`: vitest'),
        (6, 'Estructura de carpetas', '```\nsrc/\n  utils/\n    consumer.ts\n    math.spec.ts\n    math.ts\n```'),
        (7, 'Endpoints principales', '- **GET** /orders (`src/backend/orders.ts:1`)\n- **GET** /users (`src/backend/routes.ts:1`)\n- **POST** /users (`src/backend/routes.ts:4`)'),
        (8, 'Instrucciones para ejecutar frontend y backend', '- Ejecuta `npm run dev` para iniciar el servidor de desarrollo del frontend.'),
    ]),
    "explain_fixture": values("frontend, backend, dependencies, flow_failed:boolean, omitted, changed", [
        ('react', None, 'react,lodash', True, 'Stack de backend', 'Principales dependencias,Flujo principal de la aplicación'),
    ]),
    "flow_fixture": values("kind, text", [
        ('component', 'Card (ui.tsx)'),
        ('component', 'Panel (ui.tsx)'),
        ('endpoint', 'GET /items/:id (api.js)'),
    ]),
    "manager_fixture": values("id:int, manager", [
        (1, 'pnpm'),
        (2, 'yarn'),
        (3, 'npm'),
    ]),
    "bus_fixture": values("seq:bigint, event, valid:boolean", [
        (1, '{"type":"indexing","progress":0.0}', True),
        (2, '{"type":"indexing","file":"a.ts","progress":25.0}', True),
        (3, '{"type":"success","message":"Indexación completa (4 archivos)"}', True),
        (4, '{"type":"seed","amount":1}', True),
        (5, '{"type":"warning","message":"Revisión pre-commit con hallazgos"}', True),
        (6, '{"type":"warning","message":"d"}', True),
        (8, '{"type":"error","message":"evento sin datos"}', True),
    ]),
    "actions_fixture": values("id:int, action, effect", [
        (1, 'analyze-repository', 'explain'),
        (2, 'mute-messages', 'log'),
        (3, None, None),
        (4, None, None),
        (5, 'close-mascot', 'stop'),
    ]),
    "seed_texts_fixture": values("id, detail, buttons, error", [
        ('s1', 'Tipo: tip\nDescripción: d\nUbicación: a.ts:3\nAcción sugerida: eliminar', 'Marcar en revisión,Resolver,Ignorar', None),
        ('s2', 'Tipo: problema\nDescripción: e', 'Resolver,Ignorar', 'Transición inválida para la Semilla "s2": no se puede pasar de "En revisión" a "Pendiente". Transiciones válidas desde "En revisión": Resuelta, Ignorada.'),
        ('s3', 'Tipo: tip\nDescripción: f', '', 'Transición inválida para la Semilla "s3": no se puede pasar de "Resuelta" a "Ignorada". Transiciones válidas desde "Resuelta": (ninguna, estado terminal).'),
        ('s4', 'Tipo: tip\nDescripción: g', 'Marcar en revisión,Resolver,Ignorar', 'No se encontró la Semilla con id "s4".'),
    ]),
    "windows_fixture": values("id:int, inside:boolean", [
        (1, True),
        (2, False),
        (3, True),
        (4, False),
        (5, False),
    ]),
    "texts_fixture": values("t, escaped, commented, frames, schema", [
        ("'", '&#39;', "// '", '', 'array'),
        ('  a<b & "c"', '  a&lt;b &amp; &quot;c&quot;', '  // a<b & "c"', 'x\ny', '{ a: number, b: string }'),
    ]),
    "animations_fixture": values("mascot, at:bigint, animation", [
        ('m', 0, 'idle'),
        ('m', 100, 'celebration'),
        ('m', 12000, 'idle'),
        ('m', 3100, 'perch-on-file'),
        ('m', 9000, 'analysis-complete'),
    ]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
