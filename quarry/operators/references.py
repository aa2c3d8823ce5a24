"""Operators on names and their occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.findings import confidence, suggested_action
from ..functions.text import lines, tokens
from ..sources.tables import Workspace


def token_lines(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """path, line, token, is_test and n: how often a token stands on a line. Input: path, content, is_test.

    With names (name), tokens that are none of them go before anything is grouped.
    """
    by_line = files.select("path", "is_test", F.posexplode(lines(F.col("content"))).alias("at", "text"))
    every = by_line.select("path", (F.col("at") + 1).alias("line"), F.explode(tokens(F.col("text"))).alias("token"), "is_test")
    if names is not None:
        every = every.join(names.select(F.col("name").alias("token")).distinct(), "token", "left_semi")
    return every.groupBy("path", "line", "token", "is_test").agg(F.count(F.lit(1)).alias("n"))


def unused_names(declared: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, n_real, n_test, confidence, suggested_action of declared names (path, name, line), used ones too.

    Occurrences reduce to one row per token before they meet the declarations, and what a declaration's own line holds
    is taken off, so a token that is everywhere costs one row, not one per occurrence and declaration.
    """
    every = files.select("is_test", F.explode(tokens(F.col("content"))).alias("token"))
    every = every.join(declared.select(F.col("name").alias("token")).distinct(), "token", "left_semi")
    totals = every.groupBy("token").agg(F.count_if(~F.col("is_test")).alias("real"), F.count_if("is_test").alias("test"))
    own_line = F.element_at(lines(F.col("content")), F.col("line"))
    own = declared.join(files, "path").select("path", "name", "line", "is_test", F.size(F.filter(tokens(own_line), lambda t: t == F.col("name"))).alias("own"))
    met = own.join(totals, F.col("name") == F.col("token"), "left")
    counts = met.select(
        "path", "name",
        (F.coalesce("real", F.lit(0)) - F.when(~F.col("is_test"), F.col("own")).otherwise(0)).cast("long").alias("n_real"),
        (F.coalesce("test", F.lit(0)) - F.when(F.col("is_test"), F.col("own")).otherwise(0)).cast("long").alias("n_test"),
    )
    sure = confidence(F.col("n_real"), F.col("n_test"), F.lit(0), F.lit(0))
    return counts.withColumn("confidence", sure).withColumn("suggested_action", suggested_action(F.col("confidence")))


def usages(declared: DataFrame, occurrences: DataFrame) -> DataFrame:
    """path, name, used_in, line, n: lines that hold a declared name, its own line aside. Input: token_lines().

    Every declaration of a name meets every line that holds it: for one name, or few. usage_counts() is for all.
    """
    rows = occurrences.select(F.col("token").alias("name"), F.col("path").alias("used_in"), F.col("line").alias("at"), "n")
    own = (F.col("path") == F.col("used_in")) & (F.col("line") == F.col("at"))
    return declared.join(rows, "name").where(~own).select("path", "name", "used_in", F.col("at").alias("line"), "n")


def usage_counts(declared: DataFrame, occurrences: DataFrame) -> DataFrame:
    """name, used_in, line, n, n_links: one row per line that holds a declared name, with the number of declarations that it
    uses; a line that only declares the name itself has none and is left out. Input: declared path, name, line (each once);
    token_lines().

    Declarations reduce to one row per name first, so rows grow with the texts however many files declare a name.
    """
    names = declared.groupBy("name").agg(F.count(F.lit(1)).alias("n_declared"))
    own = declared.select("name", F.col("path").alias("used_in"), "line", F.lit(1).alias("own"))
    rows = occurrences.select(F.col("token").alias("name"), F.col("path").alias("used_in"), "line", "n").join(names, "name").join(own, ["name", "used_in", "line"], "left")
    return rows.withColumn("n_links", F.col("n_declared") - F.coalesce("own", F.lit(0))).where("n_links > 0").select("name", "used_in", "line", "n", "n_links")


def usage_links(declared: DataFrame, occurrences: DataFrame) -> DataFrame:
    """kind, name, path, line, n, n_links: all links between declarations and lines, without listing pairs.

    Rows of kind ``declaration`` are the members of a name's class (n and n_links null), those of kind ``usage`` are
    usage_counts(). A usage links with each declaration of its name but the one on its own line.
    """
    return _with_members(declared, usage_counts(declared, occurrences))


def _with_members(declared: DataFrame, counts: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    members = declared.select(F.lit("declaration").alias("kind"), "name", "path", F.col("line").cast("int").alias("line"), none.alias("n"), none.alias("n_links"))
    used = counts.select(F.lit("usage").alias("kind"), "name", F.col("used_in").alias("path"), F.col("line").cast("int").alias("line"), "n", "n_links")
    return members.unionByName(used)


def usage_links_of(declared: DataFrame, files: DataFrame, work: Workspace) -> DataFrame:
    """usage_links() of files (path, content).

    Texts are dealt by path once and meet their own declarations whole, so occurrences, which are many more, are counted
    where they are. Declarations and names are written first: their true size tells whether they go to all tasks.
    """
    declared = work.settle(declared.select("path", "name", "line"))
    names = work.settle(declared.groupBy("name").agg(F.count(F.lit(1)).alias("n_declared")))
    own = declared.groupBy(F.col("path").alias("of")).agg(F.collect_list(F.struct("line", "name")).alias("own"))
    dealt = files.select("path", "content").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    by_line = dealt.join(own, F.col("path") == F.col("of"), "left").select("path", "own", F.posexplode(lines(F.col("content"))).alias("at", "text"))
    here = F.transform(F.filter("own", lambda x: x["line"] == F.col("at") + 1), lambda x: x["name"])
    every = by_line.select("path", (F.col("at") + 1).alias("line"), here.alias("own"), F.explode(tokens(F.col("text"))).alias("token"))
    met = every.select("path", "line", "token", F.coalesce(F.array_contains("own", F.col("token")), F.lit(False)).alias("own")).join(names, F.col("token") == F.col("name"))
    counts = met.groupBy(F.col("path").alias("used_in"), "line", "name", "own", "n_declared").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("n_links", F.col("n_declared") - F.col("own").cast("int")).where("n_links > 0")
    return _with_members(declared, counts.select("name", "used_in", "line", "n", "n_links"))
