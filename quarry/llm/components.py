"""Connected components of a graph: contraction within tasks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (for a small star, only smaller ones) are tied to the least of them and the node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    tied = both.join(least, F.col("a") == F.col("of"))
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


#: Edges that one task contracts.
TASK_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: each node tied to the least node that these edges join it with."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    tied = [(x, y) for x in nodes if (y := root(x)) != x]
    yield pa.RecordBatch.from_pydict({"a": [x for x, _ in tied], "b": [y for _, y in tied]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (a, b) but of loops: the least node that it is joined with.

    Tasks contract up to TASK_EDGES edges each to stars. Where there are several, rounds of stars follow, whose number
    grows with the logarithm of the longest path, until every node that is tied to a smaller one is tied to that one only,
    which is tied to none: these are stars, each of them a whole component. A node with many neighbours is one key of joins that Spark can split. Edges stay in the cluster.
    """
    edges = settle(edges.select("a", "b").where("a <> b"), "edges")
    tasks = -(-edges.count() // TASK_EDGES) or 1
    edges = settle(edges.coalesce(tasks).mapInArrow(_contract, "a long, b long"), "stars")
    while tasks > 1:
        edges = settle(_star(_star(edges, True), False), "edges")
        inner = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")
        torn = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        if inner.unionByName(torn).isEmpty():
            break
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return settle(leaves.unionByName(leaves.select(F.col("label").alias("node"), "label").distinct()), "labels")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (node, label) after more edges: only the components that these join are labelled anew."""
    one, two = (labels.select(F.col("node").alias(s), F.col("label").alias(f"of_{s}")) for s in "ab")
    between = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b")
    between = settle(between.distinct(), "between")
    if between.isEmpty():
        return labels
    anew = components(between).select(F.col("node").alias("was"), F.col("label").alias("now"))
    kept = labels.join(anew, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    fresh = anew.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return settle(kept.unionByName(fresh), "labels")
