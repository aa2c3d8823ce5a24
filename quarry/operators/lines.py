"""Operators on lines of files: runs of comments, windows of lines, duplicate blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim, lines

#: Lines of a run; of a window; equal lines of duplicates; width of a length class.
RUN, WINDOW, EQUAL, BUCKET = 3, 5, 4, 20


def numbered(files: DataFrame, content: str = "content") -> DataFrame:
    """path, line (from 1), text for every line."""
    return files.select("path", F.posexplode(lines(F.col(content))).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def runs(flagged: DataFrame, least: int = RUN) -> DataFrame:
    """path, start_line, end_line, n_lines of maximal runs of flagged lines. Input: path, line, flag."""
    on = flagged.where("flag").select("path", "line")
    island = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    grouped = on.withColumn("island", island).groupBy("path", "island")
    return grouped.agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines") >= least).drop("island")


def commented(files: DataFrame) -> DataFrame:
    """path, line, text, flag: whether a line is a comment as a whole.

    In a block comment, a line is one until the block ends, and the ending line if nothing follows the end. Whether a line
    starts within a block follows from the last line before it that leaves one state whatever came before, and from how
    many have changed the state since (only lines like ``/*/`` do).
    """
    s = js_trim(F.col("text"))
    tail = F.substring(s, 3, 1 << 30)
    starts = F.startswith(s, F.lit("/*"))
    opens = starts & ~F.contains(tail, F.lit("*/"))
    closes = F.contains(s, F.lit("*/"))
    rows = numbered(files).select("path", "line", "text", s.alias("s"), tail.alias("tail"), starts.alias("starts"), opens.alias("opens"), closes.alias("closes"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("opens") & F.col("closes")).cast("int")).over(before), F.lit(0))
    rows = rows.withColumn("turns", turns)
    sets = F.when(F.col("opens") != F.col("closes"), F.struct(F.col("opens").alias("to"), F.col("turns").alias("at")))
    last = F.last(sets, ignorenulls=True).over(before)
    rows = rows.withColumn("last", last)
    within = F.coalesce(F.col("last.to"), F.lit(False)) != ((F.col("turns") - F.coalesce("last.at", F.lit(0))) % 2 == 1)
    rows = rows.withColumn("within", within)
    body = F.when(F.col("within"), F.col("s")).otherwise(F.col("tail"))
    nothing_after = js_trim(F.substring(body, F.length(F.substring_index(body, "*/", 1)) + 3, F.lit(1 << 30))) == ""
    block = F.col("within") | F.col("starts")
    flag = F.when(block, ~F.contains(body, F.lit("*/")) | nothing_after).otherwise(F.startswith("s", F.lit("//")))
    return rows.select("path", "line", "text", flag.alias("flag"))


def windows(lined: DataFrame, size: int = WINDOW) -> DataFrame:
    """path, start_line, end_line, window (trimmed lines), total, bucket of windows without blank lines.

    Input: path, line, text and, where known, flag; windows of flagged lines alone are left out.
    """
    over = Window.partitionBy("path").orderBy("line").rowsBetween(0, size - 1)
    flag = F.col("flag") if "flag" in lined.columns else F.lit(False)
    rows = lined.select("path", "line", js_trim(F.col("text")).alias("t"), flag.alias("c"))
    framed = rows.select("path", F.col("line").alias("start_line"), F.collect_list("t").over(over).alias("window"), F.bool_and("c").over(over).alias("comment"))
    whole = framed.where((F.size("window") == size) & ~F.array_contains("window", "") & ~F.col("comment")).drop("comment")
    total = F.aggregate("window", F.lit(0), lambda n, x: n + F.length(x))
    return whole.withColumn("end_line", F.col("start_line") + size - 1).withColumn("total", total).withColumn("bucket", F.round(F.col("total") / BUCKET).cast("int"))


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\n", *parts).cast("binary")))


def digests(w: DataFrame) -> DataFrame:
    """Windows with cls, a digest of their lines, and keys, those of the lines without each one. Lines of one length class
    alone can be alike: the class goes into all digests."""
    bucket, line = F.col("bucket").cast("string"), lambda j: F.col("window")[j]
    keys = [_digest(bucket, F.lit(f"without {i}"), *[line(j) for j in range(WINDOW) if j != i]) for i in range(WINDOW)]
    return w.select("bucket", "path", "start_line", "end_line", _digest(bucket, *[line(j) for j in range(WINDOW)]).alias("cls"), F.array(*keys).alias("keys"))


def similar_windows(w: DataFrame) -> DataFrame:
    """Pairs of windows in one length class with four of five equal lines in place, not overlapping in one file.

    Windows of equal lines are a class. Two classes whose lines differ in one place meet under one key, the lines without
    it, so an equi-join of classes finds each pair of them once; their windows are brought together after that.
    """
    rows = digests(w)
    classes = rows.groupBy("cls").agg(F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n"))
    keyed = classes.select("cls", F.explode("keys").alias("key"))
    other = keyed.select(F.col("cls").alias("other"), "key")
    unlike = keyed.join(other, "key").where("cls < other").select("cls", "other", F.lit(EQUAL).alias("equal_lines"))
    alike = classes.where("n > 1").select("cls", F.col("cls").alias("other"), F.lit(WINDOW).alias("equal_lines"))
    places = ("path", "start_line", "end_line")
    one, two = (rows.select(F.col("cls").alias(c), *(["bucket"] if s == "p" else []), *[F.col(x).alias(f"{s}_{x}") for x in places]) for c, s in (("cls", "p"), ("other", "q")))
    pairs = alike.unionByName(unlike).join(one, "cls").join(two, "other")
    first = (F.col("p_path") < F.col("q_path")) | ((F.col("p_path") == F.col("q_path")) & (F.col("p_end_line") < F.col("q_start_line")))
    last = (F.col("q_path") < F.col("p_path")) | ((F.col("p_path") == F.col("q_path")) & (F.col("q_end_line") < F.col("p_start_line")))
    kept = pairs.where(first | (last & (F.col("cls") != F.col("other"))))
    ends = [F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{s}_{c}") for s, x, y in (("a", "p", "q"), ("b", "q", "p")) for c in places]
    return kept.select("bucket", *ends, "equal_lines")
