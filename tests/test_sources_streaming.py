import os

import pytest

from quarry.sources import repository
from quarry.streaming import index, seeds


@pytest.fixture
def repo(tmp_path):
    files = {".gitignore": "dist/\n*.generated.ts\n", "src/index.ts": "a\nprocess.env.PORT + import.meta.env.API_URL", "dist/x.js": "b", "src/m.generated.ts": "c", "node_modules/p/i.js": "d", "src/secrets.ts": "e", "README.md": "f", "src/b.jsx": "process.env.PORT"}
    for name, content in files.items():
        os.makedirs(tmp_path / "repo" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "repo" / name).write_text(content)
    return f"file://{tmp_path}/repo"


def test_scan(spark, repo):
    got = repository.scan(spark, repo)
    assert {r.path for r in got.collect()} == {"src/index.ts", "src/b.jsx"}
    assert [r.name for r in repository.env_names(got).collect()] == ["API_URL", "PORT"]


def test_manifest_and_env_files(spark):
    text = spark.createDataFrame([('{"name": "x", "scripts": {"dev": "vite"}, "dependencies": {"react": "1"}}',), ("no json",)], "content string")
    a, b = repository.manifest(text).collect()
    assert a.name == "x" and a.scripts == {"dev": "vite"} and b.name is None
    files = spark.createDataFrame([(".env.sample", "A=1\nB=2"), (".env.example", "# c\n X =1\n\nY=2\nX=3")], "path string, content string")
    assert [r.name for r in repository.env_file_names(files).collect()] == ["X", "Y", "X"]


def test_seed_store(spark, tmp_path):
    path = f"file://{tmp_path}/seeds"
    assert repository.read_seeds(spark, path).count() == 0
    rows = spark.createDataFrame([("i", "tip", "m", None, "d", None, "Pendiente", None, None)], repository.SEED)
    assert not repository.write_seeds(rows, path) and repository.read_seeds(spark, path).count() == 0
    assert repository.write_seeds(rows, path, consent=True) and repository.read_seeds(spark, path).collect() == rows.collect()


def test_edits():
    yes, no = (lambda _: True), (lambda _: False)
    assert repository.apply_edit(["a", "  b"], 2, "comentar", yes) == ["a", "  // b"] and repository.apply_edit(["a", "b"], 1, "eliminar", yes) == ["b"]
    assert repository.apply_edit(["a"], 1, "eliminar", no) is repository.apply_edit(["a"], 2, "eliminar", yes) is None


@pytest.mark.parametrize("merge", [16, 2, 1])
def test_incremental_index_is_the_full_one(spark, tmp_path, monkeypatch, merge):
    monkeypatch.setattr(index, "MERGE", merge)
    source, table = f"file://{tmp_path}/changes", f"file://{tmp_path}/files"
    batches = [[(1, "a.ts", "create", "1"), (2, "b.ts", "create", "2"), (3, "a.ts", "modify", "3"), (4, "x.md", "create", "no")], [(5, "b.ts", "delete", None), (6, "c.js", "create", "4"), (7, "dist/d.js", "create", "no")], [(8, "b.ts", "create", "5"), (9, "c.js", "delete", None), (10, "gone.ts", "delete", None)]]
    for rows in batches:
        spark.createDataFrame(rows, index.CHANGE).coalesce(1).write.mode("append").json(source)
        index.maintain(spark, spark.readStream.schema(index.CHANGE).json(source), table, f"file://{tmp_path}/checkpoint", "dist/").awaitTermination()
    assert {(r.path, r.content) for r in index.current(spark, table).collect()} == {("a.ts", "3"), ("b.ts", "5")}


def test_transition_stream_keeps_state(spark, tmp_path):
    source = f"file://{tmp_path}/requests"
    schema = "seed_id string, seq long, new_state string"
    out = []
    for rows in ([("s", 1, "En revisión"), ("t", 2, "Resuelta"), ("s", 3, "Pendiente")], [("s", 4, "En revisión"), ("s", 5, "Ignorada"), ("t", 6, "Ignorada")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = seeds.transition_stream(spark.readStream.schema(schema).json(source))
        stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r[1], r[3], r[4]) for r in out) == [(1, True, "En revisión"), (2, True, "Resuelta"), (3, False, "En revisión"), (4, False, "En revisión"), (5, True, "Ignorada"), (6, False, "Resuelta")]


def test_animations(spark):
    rows = spark.createDataFrame([("m", 0, 1, "idle"), ("m", 100, 2, "celebration"), ("m", 200, 3, "perch-on-file"), ("m", 9000, 4, "analysis-complete")], "mascot string, at long, seq int, animation string")
    assert [tuple(r)[1:] for r in seeds.animations(rows).orderBy("at").collect()] == [(0, "idle"), (100, "celebration"), (3100, "perch-on-file"), (9000, "analysis-complete"), (12000, "idle")]
