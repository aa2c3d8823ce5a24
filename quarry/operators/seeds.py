"""Operators on findings and seeds, the tasks they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.findings import TRANSITIONS, diagnostic_severity, seed_type
from ..functions.text import shortened

FINDING = ["type", "source_module", "path", "line", "description", "suggested_action", "confidence"]


def union(*parts: DataFrame) -> DataFrame:
    """Findings of several modules, columns that a module lacks being null."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    missing = [F.lit(None).cast("string").alias(c) for c in FINDING if c not in first.columns]
    return first.select("*", *missing)


def create(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A pending seed for each finding; its id follows from the finding's keys, so a replay makes the same ones."""
    location = F.when(F.col("path").isNotNull() & F.col("line").isNotNull(), F.struct("path", "line", F.lit(1).alias("column")))
    return findings.select(
        F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256).alias("id"), *[k for k in keys if k not in FINDING],
        seed_type(F.col("type"), F.col("confidence")).alias("type"), "source_module", location.alias("location"), "description", "suggested_action", F.lit("Pendiente").alias("state"),
    )


def transitions(requests: DataFrame) -> DataFrame:
    """requests (seed_id, seq, new_state) with whether each was accepted, and the state after it.

    All allowed paths end with the first request of a final state, and may pass the first request of a review before it.
    So a request is accepted if it is the first of those two kinds, and the review's comes before the final one.
    """
    final = [s for s, n in TRANSITIONS.items() if not n]
    every = Window.partitionBy("seed_id")
    to = F.col("new_state")
    firsts = requests.withColumn("end", F.min(F.when(to.isin(final), F.col("seq"))).over(every)).withColumn("review", F.min(F.when(to == "En revisión", F.col("seq"))).over(every))
    reviewed = F.col("review").isNotNull() & (F.col("end").isNull() | (F.col("review") < F.col("end")))
    accepted = F.coalesce(F.col("seq") == F.col("end"), F.lit(False)) | (reviewed & F.coalesce(F.col("seq") == F.col("review"), F.lit(False)))
    so_far = every.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = firsts.withColumn("accepted", accepted)
    state = F.coalesce(F.last(F.when(F.col("accepted"), F.col("new_state")), True).over(so_far), F.lit("Pendiente"))
    return marked.withColumn("state", state).drop("end", "review")


def pending(seeds: DataFrame) -> DataFrame:
    return seeds.where("state = 'Pendiente'")


def carrying(changes: DataFrame) -> DataFrame:
    """changes (seq, a number, and delta) with whether any seed is pending after each.

    Ranges of seq, one per shuffle partition, have running sums of their own, to which the sums of earlier ranges are
    added: no task sees all rows. The ranges' bounds and sums are found when this is called.
    """
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(changes.approxQuantile("seq", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col("seq")))
    sums = {r.part: r.sum for r in changes.groupBy(part.alias("part")).agg(F.sum("delta").alias("sum")).collect()}  # one row per range
    known, ahead = None, []
    for i in range(len(bounds) + 1):
        ahead.append(known)
        known = known if sums.get(i) is None else (known or 0) + sums[i]
    inside = F.sum("delta").over(Window.partitionBy(part).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    before = F.array(*map(F.lit, ahead)).cast(T.ArrayType(changes.select(F.sum("delta")).schema[0].dataType))[part]
    return changes.withColumn("pending", F.coalesce(inside + before, inside, before)).withColumn("carrying", F.col("pending") > 0)


def basket(seeds: DataFrame, most: int = 60) -> DataFrame:
    """Rows of the basket: shortened label, type and tooltip of pending seeds."""
    return pending(seeds).select("id", shortened(F.col("description"), most).alias("label"), "type", F.col("description").alias("tooltip"))


def diagnostics(findings: DataFrame, by: Column) -> DataFrame:
    """path, diagnostics: findings with a file, by file, with severity and 0-based line, in the order of ``by``."""
    item = F.struct(by.alias("seq"), diagnostic_severity(F.col("description"), F.col("confidence")).alias("severity"), F.greatest(F.lit(0), F.coalesce("line", F.lit(1)) - 1).alias("line"), "description")
    return findings.where("path IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("diagnostics"))
