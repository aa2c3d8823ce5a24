"""Maintained tables against tables made anew, over streams of changes."""

import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.streaming import index, views


def imports(files):
    """Lines that start with "import" import a path."""
    by_line = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).where("text LIKE 'import %'")
    return by_line.select("path", F.col("at").cast("long").alias("seq"), F.substring("text", 8, 1000).alias("stem"))


def anew(spark, files):
    """The same from all files: edges, orphans, totals."""
    df = spark.createDataFrame(sorted(files.items()), "path string, content string")
    edges = graph.first_match(imports(df), df, ["path", "seq"])
    totals = {}
    for path, content in files.items():
        test = ".spec." in path
        for word in re.findall(r"[A-Za-z0-9_$]+", content):
            real, tests = totals.get(word, (0, 0))
            totals[word] = (real + (not test), tests + test)
    alone = graph.orphans(df.select("path"), edges)
    return {tuple(r) for r in edges.select("path", "seq", "target").collect()}, {r.path for r in alone.collect()}, {(k, *v) for k, v in totals.items()}


def held(v):
    return {tuple(r) for r in v.current_edges().collect()}, {r.path for r in v.current_orphans().collect()}, {tuple(r) for r in v.current_totals().collect()}


@pytest.mark.parametrize("merge", [2])
def test_batches_give_what_a_full_build_gives(spark, tmp_path, merge):
    rng = random.Random(merge)
    v = views.Views(spark, f"file://{tmp_path}/index", imports, buckets=4, merge=merge)
    names = ["a.ts", "a.jsx", "a/index.ts", "b.ts", "b.spec.ts", "c.js", "d/index.js"]
    files, seq = {}, 0
    for batch in range(4):
        rows = []
        for _ in range(rng.randint(2, 6)):
            path, seq = rng.choice(names), seq + 1
            if rng.random() < 0.3:
                rows.append((seq, path, "delete", None))
                files.pop(path, None)
            else:
                text = "\n".join(rng.choice(["import a", "import b", "import a/index", "import d", "import none", "x y x", "z"]) for _ in range(rng.randint(1, 4)))
                rows.append((seq, path, "modify", text))
                files[path] = text
        changes = spark.createDataFrame(rows, index.CHANGE)
        v.update(changes, batch)
        if batch == 2:
            v.update(changes, batch)  # a batch that runs again changes nothing
        assert held(v) == (anew(spark, files) if files else (set(), set(), set()))


def test_a_batch_reads_no_unchanged_path(spark, tmp_path):
    """Buckets that hold other paths are spoilt before the second batch, and no file is parsed that didn't change."""
    seen = spark.sparkContext.accumulator(0)

    def counted(files):
        files.foreach(lambda _: seen.add(1))
        return imports(files)

    v = views.Views(spark, f"file://{tmp_path}/index", counted, buckets=64)
    rows = [(i, f"f{i}.ts", "create", f"import f{i + 1}\nword{i}") for i in range(30)]
    v.update(spark.createDataFrame(rows, index.CHANGE), 0)
    assert seen.value == 30
    lookup = spark.createDataFrame([("f3.ts",)], "path string")
    own = {log: v._buckets(log, lookup, "path") for log in (v.words, v.imports, v.edges)}
    spoilt = 0
    for log, buckets in own.items():
        for part in glob.glob(f"{tmp_path}/index/{os.path.basename(log.top)}/version=0/bucket=*/*.parquet"):
            if int(part.split("bucket=")[1].split("/")[0]) not in buckets:
                with open(part, "wb") as out:
                    out.write(b"spoilt")
                spoilt += 1
    assert spoilt > 50
    v.update(spark.createDataFrame([(99, "f3.ts", "modify", "import f9\nword3 word3")], index.CHANGE), 1)
    assert seen.value == 31
    gained = {tuple(r) for r in v.edges.rows(1 << 62, own[v.edges]).where("path = 'f3.ts'").collect()}
    assert gained == {("f3.ts", 0, "f4.ts", 1), ("f3.ts", 0, "f4.ts", -1), ("f3.ts", 0, "f9.ts", 1)}


def test_a_stream_of_changes(spark, tmp_path):
    source = f"file://{tmp_path}/changes"
    v = views.Views(spark, f"file://{tmp_path}/index", imports, buckets=4)
    for rows in ([(1, "a.ts", "create", "import b"), (2, "b.ts", "create", "w")], [(3, "b.ts", "delete", None), (4, "b/index.ts", "create", "w w")]):
        spark.createDataFrame(rows, index.CHANGE).coalesce(1).write.mode("append").json(source)
        v.maintain(spark.readStream.schema(index.CHANGE).json(source), f"file://{tmp_path}/checkpoint").awaitTermination()
    files = {"a.ts": "import b", "b/index.ts": "w w"}
    assert held(v) == anew(spark, files)


def test_a_files_words_are_one_row_and_the_last_change_counts(spark, tmp_path):
    v = views.Views(spark, f"file://{tmp_path}/index", imports, buckets=4)
    v.update(spark.createDataFrame([(1, "a.ts", "create", "old"), (3, "a.ts", "modify", "y x y"), (2, "b.ts", "create", "x\nimport a")], index.CHANGE), 0)
    assert {tuple(r) for r in v.words.rows(1 << 62).collect()} == {("a.ts", "x y y", 1), ("b.ts", "a import x", 1)}
    v.update(spark.createDataFrame([(4, "a.ts", "delete", None), (5, "a/index.ts", "create", "")], index.CHANGE), 1)
    assert held(v) == anew(spark, {"a/index.ts": "", "b.ts": "x\nimport a"})
