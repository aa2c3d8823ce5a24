"""Neighbours in an order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Workspace


def predecessors(rows: DataFrame, group: str, key: str, work: Workspace) -> DataFrame:
    """group, key and ``before``: the key before it in its group, null for the first. Keys are distinct within a group.

    Rows are dealt into ranges of group and key; what a range's first row of a group follows is the last row of the group
    in the ranges before it, found among one row for each range and group. A group of most rows is many ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.settle(rows.select(group, key).repartitionByRange(n, group, key).withColumn("part", F.spark_partition_id()))
    inside = F.lag(key).over(Window.partitionBy("part", group).orderBy(key))
    lasts = dealt.groupBy(F.col(group).alias("of"), F.col("part").alias("at")).agg(F.max(key).alias("last"))
    earlier = lasts.select("of", "at", F.lag("last").over(Window.partitionBy("of").orderBy("at")).alias("earlier"))
    placed = dealt.withColumn("inside", inside).join(earlier, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return placed.select(group, key, F.coalesce("inside", "earlier").alias("before"))
