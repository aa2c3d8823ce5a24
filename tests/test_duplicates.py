"""Duplicate blocks against a sequential pass."""

import random

import pytest

from quarry.operators import duplicates, lines


def expected(files):
    """Windows in the order of path and line; each free one takes the next free one of its length class."""
    windows = []
    for path, text in sorted(files):
        rows = [x.strip() for x in text.split("\n")]
        windows += [(path, i + 1, rows[i : i + 5]) for i in range(len(rows) - 4) if "" not in rows[i : i + 5]]
    bucket = lambda w: int(sum(map(len, w[2])) / 20 + 0.5)
    used, out = set(), set()
    for i, a in enumerate(windows):
        if i in used:
            continue
        for j in range(i + 1, len(windows)):
            b = windows[j]
            if j in used or bucket(a) != bucket(b) or (a[0] == b[0] and b[1] < a[1] + 5):
                continue
            equal = sum(x == y for x, y in zip(a[2], b[2], strict=True))
            if equal >= 4:
                used |= {i, j}
                out.add((a[0], a[1], a[1] + 4, b[0], b[1], b[1] + 4, equal))
                break
    return out


def got(spark, files, **how):
    df = spark.createDataFrame(files, "path string, content string").repartition(5)
    rows = duplicates.duplicate_blocks(lines.windows(lines.numbered(df)), **how).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


def repository(seed):
    rng = random.Random(seed)
    block = [f"line number {i} of it" for i in range(9)]
    files = []
    for k in range(24):
        text = list(block[: rng.randint(5, 9)])
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = rng.choice(["line numbed 3 of it", "line numbex 4 of it"])
        if rng.random() < 0.3:
            text += ["same"] * rng.randint(1, 17)
        if rng.random() < 0.2:
            text += ["", *block]
        files.append((f"f{k:02}", "\n".join(text)))
    return [*files, ("none", ""), ("short", "a\nb\nc")]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("most", [1_000_000, 0], ids=["by component", "in rounds"])
def test_pairs_are_those_of_a_sequential_pass(spark, seed, most, caplog):
    files = repository(seed)
    want = expected(files)
    assert len(want) > 20 and {r[-1] for r in want} == {4, 5}
    with caplog.at_level("INFO", logger="quarry.operators.duplicates"):
        assert got(spark, files, most=most) == want
    assert any("blocks, round 2" in r.message for r in caplog.records) == (most == 0)


def test_a_class_of_its_own_over_many_files_and_ranges(spark):
    """One class holds everything; files hold none to twenty windows of it that overlap."""
    rng = random.Random(7)
    files = [(f"f{k:03}", "\n".join(["again and again"] * rng.choice([0, 4, 5, 5, 5, 6, 9, 10, 11, 24]))) for k in range(60)]
    assert got(spark, files) == expected(files)


def test_nothing_to_pair(spark):
    assert got(spark, [("a", "x\ny"), ("b", "")]) == set()
