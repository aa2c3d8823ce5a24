import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_dedup
from quarry.llm.common import shared_folder


def expected(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for i, r in enumerate(rows)}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(rows[i].doc_id)
    least = lambda ids: min(ids, key=lambda d: (d is None, d or 0))
    return {(r.doc_id, least(groups[norm[i]]), len(groups[norm[i]]), hashlib.sha256(norm[i].encode()).hexdigest()) for i, r in enumerate(rows)}


@pytest.fixture(scope="module")
def written(odd, documents, tmp_path_factory):
    top = tmp_path_factory.mktemp("dedup")
    odd.repartition(3).write.parquet(f"file://{top}/odd")
    documents.repartition(5).write.parquet(f"file://{top}/documents")
    return top


@pytest.mark.parametrize("which", ["odd", "documents"])
@pytest.mark.parametrize("files", [None, 1])
def test_equal_texts_keep_the_smallest_id(spark, written, which, files):
    path = f"file://{written}/{which}"
    got = exact_dedup.deduplicate(spark, path, files_per_batch=files).collect()
    rows = spark.read.parquet(path).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == expected(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_a_weak_digest_gives_the_same(spark, written):
    path = f"file://{written}/documents"
    weak = lambda text: F.substring(exact_dedup.sha256(text), 1, 1)
    strong, got = (sorted(map(tuple, exact_dedup.deduplicate(spark, path, **how).collect())) for how in ({}, {"digest": weak}))
    assert got == strong


def test_state_stays_for_later_files(spark, tmp_path):
    path, state = f"file://{tmp_path}/in", shared_folder(spark, "state")
    def put(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    put([(5, "a b"), (6, "c")])
    first = exact_dedup.deduplicate(spark, path, state=state).collect()
    put([(3, "a  b"), (7, "d")])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.deduplicate(spark, path, state=state).collect()}
    assert len(first) == 2 and got == {5: (3, 2), 3: (3, 2), 6: (6, 1), 7: (7, 1)}


def test_equal_ids_keep_one_row(spark, tmp_path):
    spark.createDataFrame([(1, "x")] * 3, "doc_id long, text string").write.parquet(f"file://{tmp_path}/in")
    got = exact_dedup.deduplicate(spark, f"file://{tmp_path}/in").collect()
    assert [r.keep_id for r in got] == [1, 1, 1] and sum(r.kept for r in got) == 1


def test_no_rows(spark, none, tmp_path):
    none.write.parquet(f"file://{tmp_path}/in")
    assert exact_dedup.deduplicate(spark, f"file://{tmp_path}/in").count() == 0
