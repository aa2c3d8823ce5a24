"""Centroid clustering by sort-means.

In each round the other centroids are sorted, for every centroid, by their distance from it. A vector starts at the
centroid of the round before and goes through the others in that order; once one lies strictly beyond twice the vector's
distance from its starting centroid, neither it nor any later one can be nearer or as near, so the scan ends. All numbers
are integers, so distances, ties and means are exact and don't depend on how rows are dealt.

The vectors never leave their tasks: a round is one pass that writes vectors with their centroids, and one aggregate.
The driver holds the centroids and their distances from each other, a table bounded by the number of clusters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, settle_at

_ASSIGNED = "vec_id long, v array<int>, cluster int, distance long"


def kept_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v, the components as integers floor(scale * x), of vectors with ``dims`` finite components.

    A component so large that squared distances wouldn't fit a long is an error.
    """
    most = math.isqrt((2**63 - 1) // (16 * dims))
    infinite = F.lit(float("inf"))
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    v = F.transform(doubles, lambda x: F.floor(x * scale))
    small = F.forall(doubles, lambda x: F.abs(x * scale) < most)
    ints = F.when(small, v.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is {most} or more")))
    return vectors.where((F.size("embedding") == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; equal ids in the order of their components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance from it, then by number, and those squared distances."""
    gaps = np.array([squares(centroids, c) for c in centroids])
    order = np.array([[j for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(gaps)], dtype=np.int64).reshape(len(gaps), -1)
    return order, np.take_along_axis(gaps, order, axis=1)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number where distances are equal, and the squared distance.

    Rows with one centroid before are scanned together, the farthest first: those that still go on are the first ones.
    """
    best, least = before.copy(), squares(x, centroids[before])
    for start in np.unique(before):
        rows = np.flatnonzero(before == start)
        rows = rows[np.argsort(-least[rows], kind="stable")]
        reach = -4 * least[rows]  # twice the distance, squared
        for other, gap in zip(order[start], gaps[start], strict=True):
            going = rows[: np.searchsorted(reach, -gap, side="right")]
            if not len(going):
                break
            d = squares(x[going], centroids[other])
            won = going[(d < least[going]) | (d == least[going]) & (other < best[going])]
            best[won], least[won] = other, squares(x[won], centroids[other])
    return best, least


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    order, gaps = neighbours(centroids)
    dims = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            x = np.asarray(v.flatten()).astype(np.int64).reshape(-1, dims)
            cluster, distance = nearest(x, np.asarray(batch.column(2)).astype(np.int64), centroids, order, gaps)
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", "cluster").mapInArrow(assign, _ASSIGNED)


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of exact means; one without vectors stays."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    new = centroids.copy()
    for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[r["cluster"]] = [s // r["n"] for s in r[2:]]
    return new


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly ``dims`` components, none null or non-finite; others (null vectors too) have no row.
    With fewer kept vectors than ``clusters`` each starts a cluster; with none there are no rows. Null and repeated ids
    are rows each; a null id starts a cluster only where other ids don't suffice. Equal vectors may give equal centroids,
    of which the first gets all. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims, scale)
    centroids = first_centroids(kept, clusters, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    rows, path = kept.withColumn("cluster", F.lit(0)), None
    for _ in range(rounds):
        rows, after = settle_at(_assigned(rows, centroids), "vectors")
        if path:
            delete(spark, path)  # the round before is not read again
        path = after
        centroids = moved(rows, centroids)
    final, _ = settle_at(_assigned(rows, centroids).drop("v"), "clusters")
    if path:
        delete(spark, path)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    table = [(i, sums[i], sum(sums.values()), d) for i, d in enumerate(digests) if i in sums]
    totals = spark.createDataFrame(table, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per cluster: bounded by their number
    return final.join(F.broadcast(totals), F.col("cluster") == F.col("of")).drop("of")
