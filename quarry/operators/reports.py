"""Operators of reports: folder trees, technology stacks, debouncing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how deep a tree is shown.
DEPTH = 3


def folder_tree(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """prefix, name, level, is_folder of the distinct prefixes of paths down to a depth; order by prefix segments."""
    parts = F.split("path", "/", -1)
    at = F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))).alias("level")
    rows = files.select("path", at).select(F.slice(parts, F.lit(1), F.col("level")).alias("segments"), "level", (F.size(parts) > F.col("level")).alias("more"), (F.col("level") < depth).alias("shown"))
    grouped = rows.groupBy("segments", "level").agg(F.bool_or(F.col("more") & F.col("shown")).alias("is_folder"))
    return grouped.select(F.array_join("segments", "/").alias("prefix"), F.element_at("segments", -1).alias("name"), "level", "is_folder")


def tree_lines(tree: DataFrame) -> DataFrame:
    """order (segments), line of a tree: two spaces per level, folders ending in a slash."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "name", F.when(F.col("is_folder"), F.lit("/")).otherwise(F.lit("")))
    return tree.select(F.split("prefix", "/", -1).alias("order"), line.alias("line"))


def render_tree(tree: DataFrame) -> DataFrame:
    """One row, text: the lines of the tree in the order of segments."""
    return tree_lines(tree).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "line"))), lambda x: x["line"]), "\n").alias("text"))


def debounced(changes: DataFrame, wait: int) -> DataFrame:
    """The last change (key, seq, at) of each burst: those after which nothing of their key follows within ``wait``."""
    following = F.lead("at").over(Window.partitionBy("key").orderBy("at", "seq"))
    return changes.withColumn("following", following).where(F.col("following").isNull() | (F.col("following") - F.col("at") > wait)).drop("following")
