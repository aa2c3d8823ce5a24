import re
import sys
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import line_dedup, ngram_join, queries, setsim
from quarry.llm.components import components

from .conftest import WORDS


def shingles(text, k, fold, short=True):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if fold else text
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w and short else set()


def linked(a, b, t):
    return bool(a and b) and 100 * len(a & b) >= t * len(a | b)


def classes(sets, t):
    """The least id that links lead to, of sets by id."""
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(sets, 2):
        if linked(sets[i], sets[j], t):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return {i: root(i) for i in sets}


@pytest.fixture(scope="module")
def near(spark):
    """Families of near copies around the threshold, shared passages, a large family, copies and short texts."""
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in WORDS for b in range(40)]
    passage = [str(x) for x in rng.choice(vocabulary, 60)]
    texts = []

    def changed(words, n):
        words = list(words)
        for i in rng.choice(len(words), n, replace=False):
            words[i] = f"new{rng.integers(10**9)}"
        return words

    for size in (6, 9, 15, 40, 120, 400):
        for _ in range(4):
            base = [str(x) for x in rng.choice(vocabulary, size)]
            texts += [base, base, [w.upper() for w in base], *[changed(base, n) for n in (1, 1, 2, 3, 5) if n < size]]
            texts += [base + [f"tail{i}" for i in range(size // 7)], base[: max(1, size * 6 // 7)]]
    family = [str(x) for x in rng.choice(vocabulary, 200)]
    texts += [changed(family, int(rng.integers(0, 6))) for _ in range(150)]
    small_family = [str(x) for x in rng.choice(vocabulary, 30)]
    texts += [changed(small_family, int(rng.integers(0, 2))) for _ in range(100)]
    texts += [[*map(str, rng.choice(vocabulary, 30)), *passage, *map(str, rng.choice(vocabulary, 25))] for _ in range(120)]
    texts += [[*passage, *passage[::-1], *changed(passage, 20)] for _ in range(90)]
    texts += [["one"], ["one"], ["one", "two", "three"], ["ONE", "two", "three"], [], []]
    rows = [(i * 2 + 1, " ".join(t), "x") for i, t in enumerate(texts)] + [(9_001, None, "x")]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "doc_id long, text string, node string").repartition(5)


@pytest.mark.parametrize(("words", "threshold"), [(4, 85), (5, 80), (2, 50)])
@pytest.mark.parametrize("tight", [False, True])
def test_components_as_by_all_pairs(near, monkeypatch, words, threshold, tight):
    if tight:  # even small groups meet pivots first
        monkeypatch.setattr(setsim, "LARGE", 3)
    sets = {r.doc_id: shingles(r.text or "", words, True) for r in near.collect()}
    want = classes(sets, threshold)
    got = ngram_join.near_duplicates(near, words, threshold).collect()
    assert len(got) == len(want)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_components_of_tables(which, request):
    docs = request.getfixturevalue(which).where("doc_id IS NOT NULL")
    want = classes({r.doc_id: shingles(r.text or "", 4, True) for r in docs.collect()}, 85)
    got = ngram_join.near_duplicates(docs, 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(want)
    kept = ngram_join.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def gone(rows, t=80):
    lines = sorted(((r.doc_id, i, shingles(x, 5, False)) for r in rows for i, x in enumerate((r.text or "").split("\n"))), key=lambda x: x[:2])
    lines = [x for x in lines if x[2]]
    return {(d, i) for k, (d, i, s) in enumerate(lines) if any(linked(s, o, t) for _, _, o in lines[:k])}


@pytest.mark.parametrize("large", [64, 3])
def test_lines_as_by_all_pairs(spark, near, documents, odd, monkeypatch, large):
    monkeypatch.setattr(setsim, "LARGE", large)
    texts = [r.text or "" for r in near.collect()]
    made = spark.createDataFrame([(i, "\n".join(texts[i * 7 : i * 7 + 7]), 5) for i in range(len(texts) // 7)], "doc_id long, text string, n_chars long")
    for docs in (made, documents.limit(120), odd.where("doc_id IS NOT NULL")):
        rows = docs.collect()
        want = gone(rows)
        got = line_dedup.deduplicate(docs).collect()
        assert {(r.doc_id, i) for r in got for i in r.removed} == want and len(got) == len(rows)
        assert {r.doc_id: (r.n_lines, r.n_removed) for r in got} == {r.doc_id: (len(r.text.split("\n")) if r.text is not None else 0, sum(d == r.doc_id for d, _ in want)) for r in rows}
        new = line_dedup.without_removed_lines(docs)
        assert new.schema == docs.schema
        for r in new.collect():
            old = next(x.text for x in rows if x.doc_id == r.doc_id)
            assert r.text == (None if old is None else "\n".join(x for i, x in enumerate(old.split("\n")) if (r.doc_id, i) not in want))


def test_null_and_equal_ids(spark):
    line = "this very line has rather many words in it"
    docs = spark.createDataFrame([(None, line), (1, line), (1, "another text " + line), (2, line), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.deduplicate(docs).collect()}
    assert got == {(None, 1, 1), (None, 0, 0), (1, 1, 0), (2, 1, 1)}
    assert sorted(r.text for r in line_dedup.without_removed_lines(docs).collect() if r.text) == ["another text " + line, line]
    assert {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == {(None, 1), (1, 1), (2, 1), (None, None)}


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    docs = spark.createDataFrame([(1, a), (None, a), (None, b), (7, a), (7, c), (7, c), (None, d), (None, d), (None, None), (None, " ")], "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, a), (None, b), (7, c), (None, d), (None, None), (None, " ")], key=str)
    rows = spark.createDataFrame([(3, a, "x", 1, "y")] * 3, "doc_id long, text string, label string, file int, whole string")
    assert [tuple(r) for r in ngram_join.one_of_each(rows).collect()] == [(3, a, "x", 1, "y")]
    assert sorted(r.text for r in line_dedup.without_removed_lines(rows).collect()) == ["", "", a]


def test_sets_that_share_a_number_are_told_apart(near, monkeypatch):
    whole = ngram_join.kind
    want = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(near, 4, 85).collect()}
    monkeypatch.setattr(ngram_join, "kind", lambda *a: replace(whole(*a), bits=7))
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(near, 4, 85).collect()} == want


def test_words_of_long_texts(monkeypatch):
    text = "ab  cd\n" * 50 + "x" * 300 + " ab cd " + "y" * 70
    data = np.frombuffer(text.encode() + b"ab", np.uint8)
    bounds = np.array([0, len(text), len(text) + 2])
    starts, h = setsim.words_of(data, bounds)
    monkeypatch.setattr(setsim, "_PIECE", 64)
    again = setsim.words_of(data, bounds)
    assert starts.tolist() == again[0].tolist() and h.tolist() == again[1].tolist()
    words = [*text.split(), "ab"]
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist())))


def test_a_common_passage_and_a_large_group_under_a_rare_shingle(spark):
    """Signatures that counting in one task takes for rare may still have large groups."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:j] + [f"n{i}"] + base[j + 1 :])) for i, j in enumerate(rng.integers(0, 60, 90).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes({i: shingles(t, 4, True) for i, t in rows}, 85)
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, 4, 85).collect()} == want


def test_no_rows(none):
    assert ngram_join.near_duplicates(none).count() == ngram_join.one_of_each(none).count() == 0
    assert line_dedup.deduplicate(none).count() == line_dedup.without_removed_lines(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**48 - 1)))
def test_sorted_numbers_round_trip(numbers):
    values = np.array(sorted(numbers), np.uint64)
    assert setsim.unpack_sorted(setsim.pack_sorted(values)).tolist() == values.tolist()


@settings(max_examples=500, deadline=None)
@given(st.data(), st.sampled_from([50, 80, 85]))
def test_similar_sets_share_a_signature(data, threshold):
    """Prefixes by any levels, in one order, of sets that are similar just so."""
    n = data.draw(st.one_of(st.integers(4, 40), st.integers(4, 500)))
    r = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    universe = np.unique(r.integers(0, 2**48, 900, dtype=np.uint64))
    level = r.choice([0, 0, 3, 6, 9, 12, 14], len(universe)).astype(np.uint8) if data.draw(st.booleans()) else np.full(len(universe), data.draw(st.sampled_from([7, 13])), np.uint8)
    x = r.choice(len(universe), n, replace=False)
    most = n - -(-threshold * n // 100)
    drop = int(r.integers(0, most + 1))
    rest = np.setdiff1d(np.arange(len(universe)), x)
    add = int(r.integers(0, most + 1))
    y = np.concatenate((x[drop:], r.choice(rest, add, replace=False)))
    if 100 * (n - drop) < threshold * (n + add) or set(x) == set(y):
        return
    one, two = ({s for s, _, _ in setsim.prefix_signatures(universe[np.sort(i)], level[np.sort(i)], int(setsim.needed(len(i), threshold)), threshold)} for i in (x, y))
    assert one & two


@pytest.mark.parametrize("task", [500_000, 20])
def test_components_of_paths_stars_and_loops(spark, monkeypatch, task):
    monkeypatch.setattr(sys.modules["quarry.llm.components"], "TASK_EDGES", task)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 501), (501, 500), (700, 700)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {500: 500, 501: 500}


def parts(edges):
    """The least node of each node's component, of edges in any order."""
    label = {i: i for e in edges for i in e}
    while new := {max(label[a], label[b]): min(label[a], label[b]) for a, b in edges if label[a] != label[b]}:
        label = {i: new.get(x, x) for i, x in label.items()}
    return label


def test_components_end_with_one_root_for_each_node(spark, monkeypatch):
    """Two tasks whose stars leave leaf 2 tied to the roots 0 and 1 after a round; then shuffled paths and trees."""
    module = sys.modules["quarry.llm.components"]
    monkeypatch.setattr(module, "TASK_EDGES", 2)
    torn = spark.createDataFrame(spark.sparkContext.parallelize([(3, 1), (4, 2), (3, 2), (4, 0)], 2), "a long, b long")
    assert sorted((r.node, r.label) for r in components(torn).collect()) == [(i, 0) for i in range(5)]
    monkeypatch.setattr(module, "TASK_EDGES", 60)
    rng = np.random.default_rng(3)
    names = rng.permutation(600).tolist()
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(names[i], names[int(rng.integers(200, i))]) for i in range(201, 320)] + [(names[i], names[j]) for i, j in zip(range(400, 480), range(480, 560), strict=True)]
    edges = [edges[i] for i in rng.permutation(len(edges))]
    rows = components(spark.createDataFrame(spark.sparkContext.parallelize(edges, 6), "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in rows) == sorted(parts(edges).items())


def test_short_lines_are_whole_tokens_in_op4(spark, documents, tmp_path):
    """Repeats of lines with fewer than five words go, by their words; blank lines stay."""
    long = "this line has rather many words"
    rows = [(1, f"a b\n{long}\n\nc"), (2, f"a  b\nA b\n{long}\nx\n"), (3, "c\nc\n \n a b"), (4, "b a"), (None, "x"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0, []), 2: (5, 2, [0, 2]), 3: (4, 3, [0, 1, 3]), 4: (1, 0, []), None: (1, 1, [0]), 5: (0, 0, [])}
    kept = line_dedup.deduplicate(documents.limit(60), short=False).collect()
    lines = {(r.doc_id, i): x for r in documents.limit(60).collect() for i, x in enumerate((r.text or "").split("\n"))}
    assert not any(len(lines[r.doc_id, i].split()) < 5 for r in kept for i in r.removed)


def test_rows_of_large_groups_are_made_once_for_both_kinds_of_pivots(spark):
    rows = [(n, 0, [{"signature": s, "size": 300} for s in range(5)]) for n in range(300)]
    nodes = spark.createDataFrame(rows, "node long, place long, shared array<struct<signature: long, size: long>>")
    pairs = setsim._pivots(setsim._by_signature(nodes))
    assert "Generate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.a, r.b) for r in pairs.collect()}
    assert {(0, n) for n in range(1, 300)} <= got and len({a for a, _ in got}) > 5


def test_open_nodes_take_their_bitmaps_once(near, monkeypatch):
    monkeypatch.setattr(setsim, "LARGE", 3)
    met, side = [], setsim._side

    def noted(rows, name):
        if "signatures" in rows.columns:
            met.append((rows.count(), rows.select("node").distinct().count()))
        return side(rows, name)

    monkeypatch.setattr(setsim, "_side", noted)
    ngram_join.near_duplicates(near, 4, 85).collect()
    assert len(met) == 2 and all(rows == nodes > 0 for rows, nodes in met)
