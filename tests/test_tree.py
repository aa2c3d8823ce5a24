"""Trees of files: planned folders, errors of single files, files written by tasks."""

import os

import pytest
from pyarrow import fs

from quarry.plans import repository as plans
from quarry.sources import repository, tree


@pytest.fixture
def root(tmp_path):
    names = ["a.ts", "b/c.js", "b/d/e.tsx", "b/d/f.md", "node_modules/p/i.js", "b/node_modules/q.js", "g/h/i/j/k.jsx"]
    for name in names:
        os.makedirs(tmp_path / "repo" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "repo" / name).write_text(f"let {os.path.basename(name)[0]} = 1")
    os.symlink(tmp_path / "repo" / "b", tmp_path / "repo" / "link")
    os.symlink(tmp_path / "repo" / "a.ts", tmp_path / "repo" / "link.ts")
    return f"file://{tmp_path}/repo"


FOUND = {"a.ts", "b/c.js", "b/d/e.tsx", "b/d/f.md", "g/h/i/j/k.jsx"}


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 256])
def test_each_file_is_listed_once(spark, root, parts):
    store, top = tree.opened(root)
    plan = tree.planned(store, top, parts)
    assert len(plan) <= parts and not any("node_modules" in f for p in plan for f, _ in p.folders)
    rows = tree.listing(spark, root, parts).collect()
    assert sorted(r.path for r in rows) == sorted(FOUND) and all(r.size == 9 and r.modification_time for r in rows)


def test_no_folder_no_rows(spark, root):
    assert tree.listing(spark, f"{root}/none").count() == 0
    assert tree.scan(spark, f"{root}/none").count() == 0


def test_a_folder_that_cannot_be_listed_is_left_out(tmp_path):
    assert tree.entries(fs.LocalFileSystem(), str(tmp_path / "none")) == ([], [])


def test_files_that_cannot_be_read_are_error_rows(spark, root, tmp_path):
    (tmp_path / "repo" / "latin.ts").write_bytes(b"// caf\xe9")
    files = tree.listing(spark, root).persist()
    assert files.count() == 6
    os.remove(tmp_path / "repo" / "a.ts")
    os.remove(tmp_path / "repo" / "b/c.js")
    os.mkdir(tmp_path / "repo" / "b/c.js")
    got = {r.path: r for r in tree.contents(files, root, batch_bytes=10).collect()}
    files.unpersist()
    assert set(got) == FOUND | {"latin.ts"}
    assert {p for p, r in got.items() if r.error} == {"a.ts", "b/c.js"} == {p for p, r in got.items() if r.content is None}
    assert "FileNotFoundError" in got["a.ts"].error and got["latin.ts"].content == "// caf�" and got["b/d/e.tsx"].content == "let e = 1"


def test_too_large_is_an_error(spark, root, monkeypatch):
    monkeypatch.setattr(tree, "LARGEST", 8)
    store, top = tree.opened(root)
    batch = next(tree._Reader({"path": root}).read(tree.Folders([(top, False)]))).select(["path", "modification_time"])
    (out,) = tree._reading(root, 100)(iter([batch]))
    assert out.column("content").to_pylist() == [None] and "larger" in out.column("error")[0].as_py()


def test_index_tells_of_errors_and_time(spark, root, tmp_path):
    (tmp_path / "repo" / "broken.ts").write_text("function (")
    files = repository.scan(spark, root)
    os.remove(tmp_path / "repo" / "a.ts")  # listed by now, read later
    repo, result = plans.build_index(files)
    row = result.first()
    assert (row.total_files, row.files_processed, row.errors) == (5, 3, 2) and row.duration_ms > 0
    assert {r.path for r in plans.unanalyzable(repo).collect()} == {"a.ts", "broken.ts"}
    assert {r.path for r in repo.files.collect()} == {"b/c.js", "b/d/e.tsx", "g/h/i/j/k.jsx", "broken.ts"}
    assert repo.symbols.count() == 0 and {r.path for r in repo.part("variables").collect()} == {"b/c.js", "b/d/e.tsx", "g/h/i/j/k.jsx"}
    repo.close()


def test_written_files_are_read_again(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    rows = [("x/a.ts", "ä\n", 1), ("x/b.ts", None, 2), (None, "lost", 3), ("c.ts", "x" * 100_000, 4)]
    files = spark.createDataFrame(rows, "path string, content string, size int").repartition(3)
    assert tree.write(files, at) == 3 == tree.write(files, at)
    assert {(r.path, r.content, r.error) for r in tree.scan(spark, at).collect()} == {("x/a.ts", "ä\n", None), ("x/b.ts", "", None), ("c.ts", "x" * 100_000, None)}
    assert tree.write(files.limit(0), at) == 0


def test_small_files_are_dealt_by_number(spark, root):
    files = tree.listing(spark, root).persist()
    assert tree.contents(files, root, task_files=2).rdd.getNumPartitions() == 3
    assert tree.contents(files, root).rdd.getNumPartitions() == 1
    assert {r.path for r in tree.contents(files, root, task_files=2).collect()} == FOUND


def test_a_removed_tree_is_gone_whole(spark, root, tmp_path):
    named = spark.createDataFrame([("a.ts",), ("b/c.js",), ("none/such.ts",), (None,)], "path string")
    tree.remove(named, root)
    assert not os.path.exists(tmp_path / "repo")
