"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to N - 1 in the order of their ids. The permutation works on pairs (x / b, x mod b) in a domain of
a * b >= N numbers; a value outside 0 to N - 1 is permuted again until it falls inside. Place p of the permuted order
goes to shard p mod k and slot p div k, so shard sizes differ by one at most, slots have no gaps, and shard and slot of
any row number can be computed without the data.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, settle

#: Rounds of the network, and the prime modulus of its round functions: products of two residues fit a long.
ROUNDS, PRIME = 6, 2**31 - 1


def round_keys(seed: str) -> list[tuple[int, int, int]]:
    def number(i: int, j: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{seed}/{i}/{j}".encode()).digest()[:8], "big") % (PRIME - 2) + 1

    return [(number(i, 0), number(i, 1), number(i, 2)) for i in range(ROUNDS)]


def domain(n: int) -> tuple[int, int]:
    """Factors a and b, near the root of n, with a * b >= n as small as a few thousand tries give: few values walk."""
    root = math.isqrt(max(n - 1, 0)) + 1
    return min(((a, -(-n // a)) for a in range(max(1, root - 2000), root + 1)), key=lambda f: (f[0] * f[1], -f[0])) if n else (1, 1)


def once(x, a: int, b: int, keys: list[tuple[int, int, int]]):
    """One pass of the network; x is a Python integer or a column."""
    left, right = (F.floor(x / b).cast("long"), x % b) if isinstance(x, Column) else divmod(x, b)
    for i, (k1, k2, k3) in enumerate(keys):
        y = ((right if i % 2 == 0 else left) * k1 + k2) % PRIME
        y = (y * y + k3) % PRIME
        y = (y * y + k2) % PRIME
        if i % 2 == 0:
            left = (left + y) % a
        else:
            right = (right + y) % b
    return left * b + right


def permute(row: int, n: int, seed: str = "shard") -> int:
    """The place of a row number in the shuffled order."""
    (a, b), keys = domain(n), round_keys(seed)
    row = once(row, a, b, keys)
    while row >= n:
        row = once(row, a, b, keys)
    return row


def permuted(row: Column, n: int, seed: str = "shard") -> Column:
    """permute() as a column. A walk passes each of the a * b - n outside values at most once, which bounds its steps."""
    (a, b), keys = domain(n), round_keys(seed)

    def step(x: Column) -> Column:
        # a fold over the keys binds the halves in each round; nested expressions would double with every round
        state = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
        table = F.array(*[F.struct(F.lit(i % 2 == 0).alias("even"), *[F.lit(k).cast("long").alias(c) for k, c in zip(ks, "pqs", strict=True)]) for i, ks in enumerate(keys)])

        def turn(s: Column, k: Column) -> Column:
            y = (F.when(k["even"], s["r"]).otherwise(s["l"]) * k["p"] + k["q"]) % PRIME
            y = (y * y + k["s"]) % PRIME
            y = (y * y + k["q"]) % PRIME
            return F.struct(F.when(k["even"], (s["l"] + y) % a).otherwise(s["l"]).alias("l"), F.when(k["even"], s["r"]).otherwise((s["r"] + y) % b).alias("r"))

        return F.aggregate(table, state, turn, lambda s: s["l"] * b + s["r"])

    first, outside = step(row), a * b - n
    if not outside:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(outside)), first, lambda x, _: F.when(x < n, x).otherwise(step(x)))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with ``row_number`` from 0 in the order of the columns ``by``, nulls first, without a task that sees all rows.

    A range partitioning is written down with its partition numbers, so that counts per partition and numbers within it
    refer to the same dealing.
    """
    dealt = settle(rows.repartitionByRange(partitions(rows.sparkSession), *by).withColumn("part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy(F.col("part").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("of", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    return dealt.withColumn("inside", inside).join(offsets, F.col("part") == F.col("of")).withColumn("row_number", F.col("ahead") + F.col("inside")).drop("part", "of", "ahead", "inside")


def shard(docs: DataFrame, shards: int = 40, seed: str = "shard") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    The law is ``rows``. Null text counts as empty: size 16, checksum 0. Ids may be null or repeat: ties are numbered by
    checksum and size, so only wholly equal rows can swap places. No rows: no rows. Extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(base, ["doc_id", "text_crc32", "size"])
    n = docs.count()
    place = permuted(F.col("row_number"), n, seed) if n else F.col("row_number")
    return rows.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
