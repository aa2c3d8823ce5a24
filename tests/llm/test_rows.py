import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import common, mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Shares by weight, what exceeds a cap dealt again, until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not over:
            return got | {s: left * weight[s] / total for s in open_}
        for s in over:
            got[s] = cap * sizes[s]
        left -= sum(got[s] for s in over)
        open_ -= over
    return got


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_mix_reaches_its_targets(which, request):
    docs = request.getfixturevalue(which)
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    total = Counter()
    for d, n in size.items():
        total[source[d]] += n
    want = targets(total)
    got = mixing.mix(docs, rows_per_slice=7).collect()
    assert len(got) == len(size) and {r.doc_id: r.size for r in got} == size
    taken = Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in total)
    again = mixing.mix(docs, rows_per_slice=1000).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_mixed_documents_are_whole(documents, odd):
    for docs in (documents, odd):
        taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
        got = mixing.mixed_documents(docs)
        assert got.columns == docs.columns
        times = Counter(r.doc_id for r in got.collect())
        assert all(times[d] == (int(r.taken / r.size + 0.5) if r.size else 0) for d, r in taken.items())
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.text == texts[r.doc_id] for r in got.collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.text(max_size=4))
def test_permutation(n, seed):
    a, b = sharding.domain(n)
    assert a * b >= n
    if n <= 300:
        assert sorted(sharding.permute(i, n, seed) for i in range(n)) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 7, 200, 211, 1009])
def test_permutation_column_is_the_same(spark, n):
    from pyspark.sql import functions as F

    got = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).collect()
    assert all(r.p == sharding.permute(r.id, n) for r in got)


def test_walks_end_inside(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "domain", lambda n: (17, 13))
    got = spark.range(40).select("id", sharding.permuted(F.col("id"), 40).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(40)) and all(r.p == sharding.permute(r.id, 40) for r in got)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_shards(which, request):
    docs = request.getfixturevalue(which)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = {r.doc_id: r for r in sharding.shard(docs).collect()}
    n = len(rows)
    for i, r in enumerate(rows):
        place, text, g = sharding.permute(i, n), (r.text or "").encode(), got[r.doc_id]
        assert (g.row_number, g.shard, g.slot, g.size, g.text_crc32, g.law, g.grown_shard) == (i, place % 40, place // 40, len(text) + 16, zlib.crc32(text), "rows", None)
    counts = Counter(r.shard for r in got.values())
    assert max(counts.values()) - min(counts[i] for i in range(40)) <= 1 and len(got) == n


def measured(text):
    words = WORD.findall(text)
    at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if at[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_measures(which, request):
    docs = request.getfixturevalue(which)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = quality_rules.apply_rules(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = measured(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert quality_rules.repeated_words(words) == measured(b" ".join(words).decode())[4]


def test_bad_host_loses_clean_documents_and_small_hosts_are_drawn_in(spark):
    clean = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "bad" if i % 20 else clean, "junk") for i in range(400)] + [(1000 + i, clean if i % 10 else "bad", f"h{i % 5}") for i in range(500)] + [(9000, "bad", "tiny"), (9001, clean, "tiny")]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i].kept for i in range(400))
    assert all(got[i].kept != got[i].base_failed for i in got if i >= 1000)


def test_passing_documents(documents, odd):
    for docs in (documents, odd):
        kept = {r.doc_id for r in quality_rules.apply_rules(docs).collect() if r.kept}
        got = quality_rules.passing_documents(docs)
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == kept


def test_rows_that_share_an_id_are_judged_each(spark):
    clean = " ".join(f"w{i}" for i in range(40))
    rows = [(5, clean, "s", "a"), (5, "short", "s", "b"), (None, clean + " x", "s", "c"), (None, None, "s", "d"), (6, clean, None, "e")]
    got = quality_rules.passing_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, row string"), limit=0.9)
    assert got.columns == ["doc_id", "text", "source", "row"] and sorted(r.row for r in got.collect()) == ["a", "c", "e"]


def test_no_rows(none):
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert quality_rules.apply_rules(none).count() == quality_rules.passing_documents(none).count() == 0


def words_by_source(rows):
    found = Counter()
    for r in rows:
        found[r.source] += len((r.text or "").split())
    return found


@pytest.mark.parametrize("ids", ["null", "equal", "mixed"])
def test_rows_without_ids_of_their_own_are_mixed_each_for_itself(spark, ids):
    """Rows with a null or the same id, wholly equal ones among them: each source comes to its target but for a document."""
    of = {"null": lambda i: None, "equal": lambda i: 5, "mixed": lambda i: [None, 5, i][i % 3]}[ids]
    rows = [(of(i), "a", " ".join(["w"] * 10), "x") for i in range(100)] + [(of(i), "b", " ".join(["v"] * (1 + i % 7)), "x") for i in range(300)] + [(of(i), None, "u", "x") for i in range(50)]
    docs = spark.createDataFrame([*rows, (None, "a", None, "x"), (5, "a", " \n", "x")], "doc_id long, source string, text string, row string")
    located = common.located(docs.repartition(3))
    out = mixing.mixed_documents(located)
    assert out.columns == docs.columns
    targets = {r.source: r.target for r in mixing.mix(located).select("source", "target").distinct().collect()}
    got = words_by_source(out.collect())
    longest = {"a": 10, "b": 7, None: 1}
    assert all(abs(got[s] - t) <= longest[s] for s, t in targets.items()), (got, targets)
    assert sorted(map(tuple, mixing.mixed_documents(located).collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
