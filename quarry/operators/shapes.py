"""Shapes of JSON texts: what stands at each path, merged over all texts of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import workspace


def _kind(value: Column) -> Column:
    """The kind of a variant, as JSON has it: object, array, string, number, boolean or null; other numbers are numbers."""
    name = F.schema_of_variant(value)
    starts = lambda *of: F.regexp_like(name, F.lit("^(" + "|".join(of) + ")"))
    kind = F.when(starts("OBJECT"), "object").when(starts("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
    return kind.when(name == "VOID", "null").otherwise("number")


def shapes(rows: DataFrame, by: str, json: str) -> DataFrame:
    """by, path, kind, n, always: how often a kind of value stands at a path in the texts of a group, and whether each text
    or object that the path goes through has one there. Texts that aren't JSON have the kind ``invalid`` at the top; null
    texts are left out.

    A path is ``$``, with a dot and a name for a field and ``[]`` for the items of a list. Each level of all texts is taken
    apart at once and added up before the next, so it takes as many steps as the deepest text has levels, and a group of most
    texts is added up where they are. Names with dots are not told from paths.
    """
    with workspace(rows.sparkSession, "shapes") as work:
        level = rows.where(F.col(json).isNotNull()).select(by, F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("value"))
        counts = []
        while True:
            seen = level.withColumn("kind", F.when(F.col("value").isNull(), "invalid").otherwise(_kind(F.col("value"))))
            counts.append(work.settle(seen.groupBy(by, "path", "kind").agg(F.count(F.lit(1)).alias("n"))))
            inner = seen.where("kind IN ('object', 'array')")
            fields = inner.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("value").outer()).select("key", F.col("value").alias("field")))
            step = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", "path", "key"))
            texts = work.settle(fields.select(by, step.alias("path"), F.to_json("field").alias("text")))
            if texts.isEmpty():
                break
            level = texts.select(by, "path", F.parse_json("text").alias("value"))
        every = counts[0]
        for c in counts[1:]:
            every = every.unionByName(c)
        above = F.regexp_replace("path", r"(\[\]|\.[^.\[]*)$", "")
        holders = every.where("kind = 'object'").select(F.col(by).alias("of"), F.col("path").alias("above"), F.col("n").alias("holders"))
        held = every.withColumn("held", F.sum("n").over(Window.partitionBy(by, "path"))).withColumn("up", above)
        found = held.join(holders, F.col(by).eqNullSafe(F.col("of")) & (F.col("up") == F.col("above")) & F.contains("path", F.lit(".")) & ~F.endswith("path", F.lit("]")), "left")
        always = F.when(F.col("path") == "$", True).otherwise(F.coalesce(F.col("held") == F.col("holders"), F.lit(False)))
        out = found.select(by, "path", "kind", "n", always.alias("always"))
        path = f"{work.top}-found"
        out.write.parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)
