import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import events
from quarry.operators import manifest, tools
from quarry.sources import repository


@pytest.mark.parametrize(("json", "valid"), [
    ('{"type":"idle"}', True), ('{"type":"idle","x":1}', False), ('{"type":"nope"}', False), ('{"type":"indexing"}', True), ('{"type":"indexing","file":"a","progress":100}', True),
    ('{"type":"indexing","file":""}', False), ('{"type":"indexing","progress":101}', False), ('{"type":"indexing","progress":"5"}', False), ('{"type":"indexing","y":1}', False),
    ('{"type":"error","message":"m"}', True), ('{"type":"error"}', False), ('{"type":"error","message":5}', False), ('{"type":"seed","amount":1000}', True), ('{"type":"seed","amount":0}', False),
    ('{"type":"seed","amount":1.5}', False), ("no json", False), ("[]", False), ('{"type":"warning","message":"' + "x" * 2001 + '"}', False),
])
def test_events(spark, json, valid):
    assert spark.createDataFrame([(json,)], "j string").select(events.valid_event(F.col("j")).alias("y")).first().y is valid


def test_actions(spark):
    rows = [('{"action":"hide-mascot"}', True), ('{"action":"hide-mascot","x":1}', False), ('{"action":"dance"}', False), ("x", False)]
    assert all(r.y == r.v for r in spark.createDataFrame(rows, "j string, v boolean").select("v", events.valid_action(F.col("j")).alias("y")).collect())


def test_mapped_events_are_valid(spark):
    rows = spark.createDataFrame([(5, 10, "a.ts", "precommit:secret", None, ""), (20, 10, "", "x", "p", "d" * 3000), (1, 0, "f", "x", "p", "")], "c int, t int, f string, k string, p string, d string")
    made = rows.select(events.indexing(F.col("c"), F.col("t"), F.col("f")).alias("a"), events.of_finding(F.col("k"), F.col("p"), F.col("d")).alias("b"), events.of_seed(F.col("c").cast("double")).alias("s"), events.of_review(F.col("c") > 5).alias("r"), events.indexed(F.col("c")).alias("i"))
    got = made.collect()
    assert got[0].a == '{"type":"indexing","file":"a.ts","progress":50.0}' and got[0].b == '{"type":"error","message":"Se detectó un posible secreto en archivo desconocido"}' and "(sin descripción)" in got[2].b
    checked = made.select(*[events.valid_event(F.col(c)).alias(c) for c in made.columns]).collect()
    assert all(all(r) for r in checked)
    texts = spark.range(3).select(events.pending_text(F.col("id")).alias("t")).collect()
    assert [r.t for r in texts] == ["0 semillas pendientes", "1 semilla pendiente", "2 semillas pendientes"]


def test_readme(spark):
    m = repository.manifest(spark.createDataFrame([('{"name": "demo", "scripts": {"dev": "vite", "build": "b"}, "dependencies": {"react": "1", "express": "2", "left": "3"}, "devDependencies": {"typescript": "5"}}',)], "content string"))
    files = spark.createDataFrame([("src/index.ts",), ("src/utils/helper.ts",)], "path string")
    ends = spark.createDataFrame([("src/index.ts", 0, "GET", "/a", 3)], "path string, seq int, method string, route string, line int")
    env = spark.createDataFrame([("PORT",)], "name string")
    got = {r.title: r for r in manifest.readme_sections(m, files, ends, env, "pnpm").collect()}
    assert got["Stack tecnológico"].content == "- React (frontend)\n- Express (backend)\n- TypeScript\n- Otras dependencias: left"
    assert got["Instalación"].content == "```bash\npnpm install\n```" and got["Endpoints principales"].content == "- **GET** /a (`src/index.ts:3`)"
    assert got["Estructura de carpetas"].content == "```\nsrc/\n  index.ts\n  utils/\n    helper.ts\n```"
    assert "frontend" in got["Instrucciones para ejecutar frontend y backend"].content and got["Scripts disponibles"].content.startswith("- `npm run dev`: vite")
    text = manifest.markdown(manifest.readme_sections(m, files, ends, env)).first().text
    assert text.startswith("# README") and text.index("## Stack") < text.index("## Scripts")
    none = manifest.readme_sections(manifest.empty_manifest(spark), files.limit(0), ends.limit(0), env.limit(0)).collect()
    assert len(none) == 8 and all(r.content is None and r.omitted_reason for r in none)


def test_explanation(spark):
    m = repository.manifest(spark.createDataFrame([('{"dependencies": {"react": "1", "react-dom": "1", "express": "1"}, "devDependencies": {"vue": "1"}}',), ('{"dependencies": {"x": "1"}}',)], "content string"))
    symbols, ends = spark.createDataFrame([("component",)], "type string"), spark.createDataFrame([("GET",)], "method string")
    a, b = manifest.explain(m, symbols, ends).collect()
    assert (a.frontend, a.backend, a.dependencies) == (["react", "vue"], ["express"], ["react", "react-dom", "express"])
    assert b.frontend == ["componentes de frontend (framework no identificado)"] and b.backend == ["endpoints de backend (framework no identificado)"]
    assert manifest.explain(m, symbols.limit(0), ends.limit(0)).collect()[1].backend is None
    pairs = spark.createDataFrame([(["a", "b", "a"], ["b", "a"], True), (None, [], True), (["a"], [], False)], "a array<string>, b array<string>, y boolean")
    assert all(r.got == r.y for r in pairs.select("y", manifest.same_items(F.col("a"), F.col("b")).alias("got")).collect())


def test_tool_outputs(spark):
    out = lambda s: spark.createDataFrame([(s,)], "output string")
    lint = '[{"filePath": "a.ts", "messages": [{"severity": 2, "line": 3, "message": "m", "ruleId": "r"}, {"severity": 1, "message": "n", "ruleId": null}]}]'
    assert [tuple(r)[1:] for r in tools.lint(out(lint)).collect()] == [("error", "a.ts", 3, "m (r)"), ("advertencia", "a.ts", 1, "n")] and tools.lint(out("oops")).count() == 0
    tests = '{"testResults": [{"name": "t.ts", "assertionResults": [{"status": "passed"}, {"status": "failed", "fullName": "x", "failureMessages": []}, {"status": "failed", "failureMessages": ["a", "b"], "location": {"line": 7}}]}]}'
    assert [tuple(r)[2:] for r in tools.tests(out(tests)).collect()] == [("t.ts", 1, 'Falló la prueba "x".'), ("t.ts", 7, "a b")]
    assert [tuple(r)[2:] for r in tools.compilation(out("noise\nsrc/a.ts(4,2): error TS2304: Cannot find x.\n")).collect()] == [("src/a.ts", 4, "TS2304: Cannot find x.")]
    assert [r.path for r in tools.untracked(out("?? new.ts\n M old.ts\n")).collect()] == ["new.ts"]
    found = tools.model_matches(out('```json\n[{"symbolName": "f", "filePath": "a.ts"}, {"symbolName": "made up", "filePath": "b.ts"}, {"filePath": "a.ts"}]\n```'), spark.createDataFrame([("f", "a.ts")], "name string, path string"))
    assert [tuple(r) for r in found.collect()] == [("f", "a.ts", 0, "")] and tools.model_matches(out("no"), found).count() == 0


def test_lines_are_the_draft(spark, tmp_path):
    m = repository.manifest(spark.createDataFrame([('{"name": "demo", "scripts": {"dev": "vite"}, "dependencies": {"react": "1", "left": "3"}}',)], "content string"))
    files = spark.createDataFrame([("src/a.ts",), ("src/b/c.ts",), ("src-x/d.ts",), ("e.ts",)], "path string").repartition(3)
    ends = spark.createDataFrame([("GET", "/b", "z.ts", 3, 1), ("PUT", "/a", "a.ts", 9, 2), ("GET", "/a", "a.ts", 8, 1), ("GET", "/a", "a.ts", 8, 1)], "method string, route string, path string, line int, seq long")
    env = spark.createDataFrame([("B",), ("A_1",)], "name string")
    for args in ((m, files, ends, env), (manifest.empty_manifest(spark), files, ends.limit(0), env), (manifest.empty_manifest(spark), files.limit(0), ends.limit(0), env.limit(0))):
        sections, lines = manifest.readme_sections(*args), manifest.readme_lines(*args)
        out = tmp_path / uuid.uuid4().hex
        assert not manifest.write_markdown(lines, f"file://{out}", lambda n: False) and not out.exists()
        assert manifest.write_markdown(lines, f"file://{out}", lambda n: n >= 0)
        assert "".join(p.read_text() for p in sorted(out.glob("part-*"))).rstrip("\n") == manifest.markdown(sections).first().text.rstrip("\n")
        left_out = {(r.section, r.omitted_reason) for r in lines.where("text IS NULL").collect()}
        assert left_out == {(r.ord, r.omitted_reason) for r in sections.where("content IS NULL").collect()}
