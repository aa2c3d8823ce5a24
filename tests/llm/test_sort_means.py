import hashlib
import math

import numpy as np
import pytest

from quarry.llm import sort_means

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, key string, distance string"


def expected(rows, clusters, rounds, seed=2, dims=64):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in kept]
        if turn == rounds:
            break
        for k in {k for _, k in found}:
            own = [v for (_, v), (_, j) in zip(kept, found, strict=True) if j == k]
            centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    total = sum(d for d, _ in found)
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    return sorted(((i, k, d, sum(e for e, j in found if j == k), total, digest(k)) for (i, _), (d, k) in zip(kept, found, strict=True)), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_all_vectors_by_brute_force(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    assert got(sort_means.cluster(vectors)) == expected([(r.vec_id, r.embedding) for r in vectors.collect()], 40, 5)


def odd_rows():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(60)]
    rows += [(i, [1.0, 0.0, -1.0, 0.5]) for i in range(100, 140)]  # ties: a third of the rows is one vector
    rows += [(None, [0.0] * 4), (None, [2.0] * 4), (7, [3.0] * 4), (7, [3.0] * 4), (200, None), (201, []), (202, [1.0] * 3), (203, [1.0] * 5)]
    return [*rows, (204, [1.0, None, 0.0, 0.0]), (205, [float("nan")] * 4), (206, [float("inf"), 0.0, 0.0, 0.0]), (207, [-1e-9, 0.0, -0.0, 1e-9])]


@pytest.mark.parametrize("clusters", [1, 2, 9, 200])
@pytest.mark.parametrize("parts", [1, 7])
def test_odd_vectors_by_brute_force(spark, clusters, parts):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1, "k", "d") for r in rows], SCHEMA).repartition(parts)
    narrow = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    assert got(sort_means.cluster(df, clusters=clusters, rounds=3, dims=4)) == expected(narrow, clusters, 3, dims=4)


def test_no_vectors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert got(sort_means.cluster(df)) == []
    assert got(sort_means.cluster(spark.createDataFrame([(1, [1.0], "", 1, "", "")], SCHEMA))) == []


def test_components_beyond_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="a component times 256"):
        sort_means.cluster(spark.createDataFrame([(1, [1e30] * 64, "", 1, "", "")], SCHEMA)).collect()


def test_the_scan_looks_at_few_centroids():
    """Vectors near their centroid stop at once; ties at exactly twice the distance are still seen."""
    centroids = np.array([[10, 0], [0, 0], [1000, 0], [2000, 0]])
    order, gaps = sort_means.neighbours(centroids)
    assert order[0].tolist() == [1, 2, 3] and gaps[0].tolist() == [100, 990**2, 1990**2]
    best, least = sort_means.nearest(np.array([[5, 0], [999, 0]]), np.array([0, 2]), centroids, order, gaps)
    assert best.tolist() == [0, 2] and least.tolist() == [25, 1]
    best, _ = sort_means.nearest(np.array([[5, 0]]), np.array([1]), centroids[[0, 1]], *sort_means.neighbours(centroids[[0, 1]]))
    assert best.tolist() == [0]  # as far from both: the smaller number, which lies at exactly twice the distance
