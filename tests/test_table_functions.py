"""Table functions of the parse stage."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.parse import functions, tables

PLAIN = {"'": "single", '"': "double", "`": "template"}


def by_character(text):
    """The class of each character, one step at a time."""
    out, i = [], 0
    while i < len(text):
        two = text[i : i + 2]
        if two == "//":
            end = text.find("\n", i) + 1 or len(text)
            kind = "line-comment"
        elif two == "/*":
            end = text.find("*/", i + 2) + 2
            end, kind = (end if end > 1 else len(text)), "block-comment"
        elif text[i] in PLAIN:
            end, kind = i + 1, PLAIN[text[i]]
            while end < len(text) and text[end] != text[i]:
                end += 2 if text[end] == "\\" else 1
            end = min(end + 1, len(text))
        else:
            end, kind = i + 1, "code"
        out += [kind] * (end - i)
        i = end
    return out


@given(st.lists(st.sampled_from(list("/*'\"`\\\nab ")), max_size=40).map("".join))
@settings(max_examples=500, deadline=None)
def test_runs_are_classes_of_characters(text):
    runs = list(functions.runs_of("p", text))
    assert [k for _, k, _, n in runs for _ in range(n)] == by_character(text)
    assert [s for _, _, s, _ in runs] == [sum(n for *_, n in runs[:i]) for i in range(len(runs))]


def test_frames_hold_many_files():
    files = [(str(i), "a 'b' // c") for i in range(1000)] + [("long", "x'y'" * 5000), ("none", None)]
    frames = list(functions.framed(iter(files), functions.runs_of, ["path", "kind", "start", "length"], [pa.string(), pa.string(), pa.int32(), pa.int32()], 3000))
    assert len(frames) == 5 and max(f.num_rows for f in frames) == 3000
    assert pa.concat_tables(frames).to_pylist() == [dict(zip(("path", "kind", "start", "length"), r, strict=True)) for p, t in files for r in functions.runs_of(p, t or "")]


def test_functions_in_sql(spark):
    rows = [("a.ts", "function f(x) { return g['x']; } // f", 1), ("b.ts", None, 2), (None, "let f", 3), ("c.ts", "function (", 4)]
    spark.createDataFrame(rows, "path string, content string, kind int").createOrReplaceTempView("sources")
    functions.register(spark)
    got = spark.sql("SELECT path, kind, start, length FROM char_classes(TABLE(sources)) ORDER BY path, start").collect()
    assert [tuple(r) for r in got] == sorted((r for p, t, _ in rows for r in functions.runs_of(p, t or "")), key=lambda r: (r[0] or "", r[2]))
    tokens = spark.sql("SELECT * FROM token_occurrences(TABLE(sources) PARTITION BY kind) WHERE token = 'x'").collect()
    assert sorted((r.path, r.offset, r.kind, r.is_dynamic) for r in tokens) == [("a.ts", 11, "code", False), ("a.ts", 26, "string", False)]
    symbols = spark.sql("SELECT path, name, type, error IS NOT NULL AS bad FROM file_symbols(TABLE(SELECT path, content FROM sources WHERE path IS NOT NULL))").collect()
    assert {tuple(r) for r in symbols} == {("a.ts", "f", "function", False), ("c.ts", None, None, True)}
    plan = spark.sql("SELECT * FROM char_classes(TABLE(sources))")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert spark.sql("SELECT * FROM char_classes(TABLE(SELECT * FROM sources WHERE kind > 9))").count() == 0


def test_occurrences_are_framed(spark):
    files = spark.createDataFrame([(f"f{i}.ts", "a b a // c") for i in range(500)] + [("empty.ts", None)], "path string, content string").coalesce(1)
    assert tables.occurrences(files).groupBy("kind").count().orderBy("kind").collect() == [("code", 1500), ("comment", 500)]
