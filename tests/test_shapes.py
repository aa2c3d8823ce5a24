import json
from collections import Counter

from quarry.operators import shapes

KINDS = {dict: "object", list: "array", str: "string", int: "number", float: "number", bool: "boolean", type(None): "null"}


def expected(rows):
    found, objects = Counter(), Counter()

    def walk(g, path, above, value):
        kind = KINDS[type(value)]
        found[g, path, above, kind] += 1
        objects[g, path] += kind == "object"
        if kind == "object":
            for k, v in value.items():
                walk(g, f"{path}.{k}", path, v)
        if kind == "array":
            for v in value:
                walk(g, path + "[]", None, v)

    for g, text in rows:
        if text is None:
            continue
        try:
            value = json.loads(text)
        except ValueError:
            found[g, "$", None, "invalid"] += 1
            continue
        walk(g, "$", None, value)
    held = Counter()
    for (g, path, _, _), n in found.items():
        held[g, path] += n
    return {(g, p, k, n, p == "$" or (above is not None and held[g, p] == objects[g, above])) for (g, p, above, k), n in found.items()}


def test_shapes_by_walking(spark):
    deep = "1"
    for i in range(9):
        deep = f'{{"d{i}": [{deep}, "x"]}}'
    rows = [
        ("a", '{"k": 1, "s": "x"}'), ("a", '{"k": 2.5}'), ("a", '{"k": null, "o": {"p": [1, true, {"q": []}], "r": {}}}'), ("a", "no json"), ("a", None),
        ("b", "[]"), ("b", "[[1], [2, [3]], {\"x\": 1}, {\"x\": \"y\", \"z\": 0}]"), ("b", '"text"'), ("b", "12345678901234567890"), (None, '{"k": {}}'), ("c", deep),
    ]
    got = {tuple(r) for r in shapes.shapes(spark.createDataFrame(rows, "g string, t string").repartition(3), "g", "t").collect()}
    assert got == expected(rows)


def test_no_texts(spark):
    assert shapes.shapes(spark.createDataFrame([], "g string, t string"), "g", "t").count() == 0
