"""What the parser and the reports make of small repositories; expectations are written by hand."""

import pytest

from quarry.parse.lexer import Broken
from quarry.parse.tables import occurrences_of
from quarry.parse.units import Unit
from quarry.plans import repository as r


def unit(text, path="a.tsx"):
    return Unit(path, text)


def symbols(text, path="a.tsx"):
    return [(s.name, s.type, s.line, s.end_line) for s in unit(text, path).symbols]


def test_functions_classes_and_components():
    u = unit("export function add(a: number, b = 2, c?: string): number {\n  return a;\n}\n")
    assert [(p["name"], p["type"], p["required"]) for p in u.symbols[0].parameters] == [("a", "number", True), ("b", "any", False), ("c", "string", False)]
    assert u.symbols[0].return_type == "number" and symbols("class A {\n  run(x) { return x; }\n  get y() { return 1; }\n  z = () => 1;\n  constructor() {}\n}") == [("A", "class", 1, 6), ("run", "function", 2, 2)]
    assert symbols("const Card = ({ t }) => <div>{t}</div>;\nconst card = () => <b/>;\nclass P extends React.Component {}\nclass Q extends Base {}") == [("Card", "component", 1, 1), ("card", "function", 2, 2), ("P", "component", 3, 3), ("Q", "class", 4, 4)]
    assert symbols("const x = 5; const g = async <T,>(a: T): Promise<T> => { return a; };\nlet h = function () { function inner() {} };") == [("g", "function", 1, 1), ("h", "function", 2, 2), ("inner", "function", 2, 2)]


def test_imports_and_exports():
    u = unit("import D, { useEffect as e, b } from 'react';\nimport * as n from './n';\nimport './x.css';\nimport type { T } from './t';\nexport { a as c, d };\nexport default D;\nexport const f = () => 1, k = 2;\nexport * from './y';\n")
    assert [(i["source"], i["specifiers"], i["is_default"]) for i in u.imports] == [("react", ["D"], True), ("react", ["e", "b"], False), ("./n", ["n"], False), ("./x.css", [], False), ("./t", ["T"], False)]
    assert [(x["name"], x["is_default"]) for x in u.exports] == [("c", False), ("d", False), ("D", True), ("f", False)]
    assert [m["source"] for m in u.modules] == ["./n", "./t", "./y"]


def test_endpoints():
    u = unit("app.get('/users/:id', (req, res) => { const { name, age: years } = req.body; use(req.query.page, req.query['size']); res.status(200).json({ id: 1, ok: true }); });\nuserRouter.POST('/users', create);\nfunction create(q, s) { save(q.body.email); s.send(x); }\ncache.get('key');\napp.get(`/t`, f);")
    a, b = u.endpoints
    assert (a["method"], a["route"], b["method"]) == ("GET", "/users/:id", "POST")
    assert [(p["name"], p["source"]) for p in a["parameters"]] == [("id", "route"), ("page", "query"), ("size", "query")]
    assert a["body"]["required"] == ["name", "age"] and b["body"]["required"] == ["email"]
    assert [(p["name"], p["type"]) for p in a["response"]["properties"]] == [("id", "number"), ("ok", "boolean")] and b["response"] == {"type": "object"}


def test_calls():
    u = unit("export function useUsers() {\n  fetch('/hook');\n}\nfetch(`/u/${id}`, { method: 'post', body: JSON.stringify({ a, b: 1, c: null }) });\naxios.put('/x', { l: [1] });\naxios({ url: '/y', method: 'delete' });\nfetch(URL);\nother.fetch('/z');")
    assert [(c["method"], c["url"], c["line"]) for c in u.calls] == [("GET", "/hook", 2), ("POST", "/u/${id}", 4), ("PUT", "/x", 5), ("DELETE", "/y", 6)]
    assert [(p["name"], p["type"]) for p in u.calls[1]["sent"]["properties"]] == [("a", "unknown"), ("b", "number"), ("c", "null")]


@pytest.mark.parametrize("text", ["function (", "const a = 'x", "/* open", "a }", "`open ${a}", "<div>", "f(]"])
def test_broken_files(text):
    with pytest.raises(Broken):
        unit(text)


@pytest.mark.parametrize("text", ["a = /[/'\"]/g; b = 1 / 2 / 3;", "x = <p>it's {a ? <b>don't</b> : null}</p>;", "`a ${b ? `c ${d}` : '}'} e`", "if (a < b && c > d) {}", "type A<T> = { [k in keyof T]: T[k] };", "#!/usr/bin/env node\nx", "const f = <T,>(x: T) => x;", "a?.b ?? c?.[0]", "label: for (;;) {}", "class A { #p = 1; static { x(); } }", "<></>", "<A.B c={d} e='f' {...g}/>", "return_(a) / b / c"])
def test_files_that_parse(text):
    unit(text)


def test_classes_of_characters():
    got = [(t, k, d) for _, t, _, _, k, d in occurrences_of("a", "foo // foo\n'foo' /* foo\n*/ x[ foo ] `foo` require('b', foo)\n" + " " * 70 + "foo")]
    assert [x for x in got if x[0] == "foo"] == [("foo", "code", True), ("foo", "comment", False), ("foo", "string", False), ("foo", "comment", False), ("foo", "code", True), ("foo", "string", False), ("foo", "code", True), ("foo", "code", False)]


@pytest.fixture(scope="module")
def workflow(spark):
    files = {
        "src/backend/routes.ts": "app.get('/users', (req, res) => {\n  res.json([]);\n});\n",
        "src/frontend/api.ts": "export function loadUsers() {\n  return fetch('/users');\n}\nexport function loadOrders() {\n  return fetch('/orders');\n}\n",
        "src/utils/math.ts": "export function add(a, b) {\n  return a + b;\n}\nexport function subtract(a, b) {\n  return a - b;\n}\n",
        "src/utils/consumer.ts": "import { add, subtract } from './math';\n\nconsole.log(add(1, 2));\n",
        "src/utils/math.test.ts": "import { add } from './math';\nadd(1, 1);\nonlyTested();\n",
        "src/tested.ts": "export function onlyTested() {}\n",
        "src/broken.ts": "function (\n",
    }
    return r.Repository.of(spark.createDataFrame(list(files.items()), "path string, content string"))


def test_dead_code(workflow):
    got = {(x.type, x.path, x.line, x.confidence, x.suggested_action) for x in r.dead_code(workflow).collect()}
    assert ("unused-import", "src/utils/consumer.ts", 1, "alto", "eliminar") in got and sum(x[0] == "unused-import" for x in got) == 1
    assert {x[1:4:2] for x in got if x[0] == "unused-function"} == {("src/frontend/api.ts", "alto"), ("src/tested.ts", "medio")}
    assert {x[1] for x in got if x[0] == "orphan-file"} == {"src/backend/routes.ts", "src/frontend/api.ts", "src/utils/consumer.ts", "src/tested.ts", "src/broken.ts"}
    assert {x[1:3] for x in got if x[0] == "unused-parameter"} == {("src/backend/routes.ts", 1)} - {("src/backend/routes.ts", 1)}
    assert [x.path for x in r.unanalyzable(workflow).collect()] == ["src/broken.ts"]


def test_contract(workflow):
    got = {k: v.collect() for k, v in r.contract(workflow).items()}
    assert [(x.method, x.url, x.line) for x in got["missing"]] == [("GET", "/orders", 5)] and got["unconsumed"] == got["discrepancies"] == got["type_conflicts"] == []


def test_references(workflow):
    add = "src/utils/math.ts#add@1"
    assert {(x.path, x.line) for x in r.importers(workflow).where(f"symbol_id = '{add}'").collect()} == {("src/utils/consumer.ts", 1), ("src/utils/math.test.ts", 1)}
    assert {(x.path, x.line, x.context) for x in r.usages(workflow).where(f"symbol_id = '{add}'").collect()} == {("src/utils/consumer.ts", 3, "console.log(add(1, 2));"), ("src/utils/math.test.ts", 2, "add(1, 1);")}
    found = r.search_results(workflow, "SUB").collect()
    assert [(x.name, x.line, x.snippet.split("\n")[0]) for x in found] == [("subtract", 4, "export function subtract(a, b) {")]
    assert {(x.related, x.relation) for x in found[0].related} == {("src/utils/consumer.ts", "imported-by"), ("src/utils/math.test.ts", "imported-by")}


def test_callees_are_first_level(spark):
    files = [("a.ts", "function level0() {\n  level1();\n  const f = () => hidden();\n  gone();\n}\nfunction level1() { level2(); }\nfunction level2() {}\nfunction hidden() {}\n")]
    repo = r.Repository.of(spark.createDataFrame(files, "path string, content string"))
    assert {(x.symbol_id, x.callee_id) for x in r.callees(repo).collect()} >= {("a.ts#level0@1", "a.ts#level1@6"), ("a.ts#level1@6", "a.ts#level2@7")}
    assert not r.callees(repo).where("symbol_id LIKE '%level0%' AND callee_id LIKE '%hidden%'").count()


def test_review_and_warnings(spark, workflow):
    files = [("m.ts", "import { x } from './gone';\nimport './m2';\nx();\nfunction neverCalled() {}\n"), ("m2.ts", "// a\n// b\n// c\nlet used = 1; log(used);\n")]
    repo = r.Repository.of(spark.createDataFrame(files, "path string, content string"))
    path = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = {(x.check, x.severity, x.path, x.line) for x in r.review(repo, path("m.ts"), path("n.ts"), path("m.ts", "m2.ts")).collect()}
    assert ("broken-imports", "error", "m.ts", 1) in got and ("forgotten-files", "recomendación", "n.ts", 1) in got and ("unused-code", "advertencia", "m.ts", 4) in got
    assert [(x.type, x.path, x.start_line, x.end_line) for x in r.code_warnings(repo).collect()] == [("commented-code", "m2.ts", 1, 3)]
