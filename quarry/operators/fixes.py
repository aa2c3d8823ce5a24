"""Fixes of findings: what is proposed, and files after the fixes that were confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import commented_out, lines

#: Previews of a deleted line and of a deleted file.
NO_LINE, WHOLE_FILE = "(línea eliminada)", "(archivo completo)"


def fixable(action: Column) -> Column:
    return action.isin("eliminar", "comentar")


def proposals(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Fixable findings (type, path, line, description, suggested_action) with a preview of the fix.

    An orphan file can be deleted as a whole only; a line that isn't there shows as an empty one.
    """
    orphan, drop = F.col("type") == "orphan-file", F.col("suggested_action") == "eliminar"
    rows = findings.where(fixable(F.col("suggested_action")) & (~orphan | drop)).join(files.select("path", "content"), "path", "left")
    old = F.coalesce(F.get(lines(F.col("content")), F.col("line") - 1), F.lit(""))
    whole = F.format_string('- %s\n+ (el archivo "%s" será eliminado)', F.lit(WHOLE_FILE), "path")
    preview = F.when(orphan, whole).otherwise(F.concat(F.lit("- "), old, F.lit("\n+ "), F.when(drop, F.lit(NO_LINE)).otherwise(commented_out(old))))
    return rows.select("type", "path", "line", "description", "suggested_action", preview.alias("preview"))


def outcomes(proposed: DataFrame, files: DataFrame) -> DataFrame:
    """proposed (with confirmed) with the outcome: applied, rejected, or error where the line is gone."""
    rows = proposed.join(files.select("path", F.size(lines(F.col("content"))).alias("n_lines")), "path", "left")
    there = (F.col("type") == "orphan-file") | F.coalesce(F.col("line").between(1, F.col("n_lines")), F.lit(False))
    return rows.withColumn("outcome", F.when(~F.col("confirmed"), "rejected").when(there, "applied").otherwise("error")).drop("n_lines")


def applied_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("outcome") == "applied").alias("applied"), F.count(F.lit(1)).alias("proposed"))


def fixed_files(files: DataFrame, results: DataFrame) -> DataFrame:
    """files (path, content) after the applied fixes of outcomes(); deleted files are left out, the others are as they were.

    Line numbers are those before any fix. A line that is both commented out and deleted is deleted.
    """
    done = results.where("outcome = 'applied'")
    gone = done.where("type = 'orphan-file'").select("path").distinct()
    by_file = done.where("type <> 'orphan-file'").groupBy("path").agg(
        F.collect_set(F.when(F.col("suggested_action") == "eliminar", F.col("line"))).alias("deleted"), F.collect_set(F.when(F.col("suggested_action") == "comentar", F.col("line"))).alias("commented"),
    )
    numbered = F.transform(lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    kept = F.filter(numbered, lambda x: ~F.array_contains("deleted", x["line"]))
    text = F.array_join(F.transform(kept, lambda x: F.when(F.array_contains("commented", x["line"]), commented_out(x["text"])).otherwise(x["text"])), "\n")
    rows = files.select("path", "content").join(gone, "path", "left_anti").join(by_file, "path", "left")
    return rows.select("path", F.when(F.col("deleted").isNotNull(), text).otherwise(F.col("content")).alias("content"))
