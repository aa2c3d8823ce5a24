import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import deadline

SCHEMA = "path long, line int"


def rows(spark, n):
    return spark.range(n).select(F.col("id").alias("path"), F.lit(1).alias("line"))


def running(spark):
    return spark.sparkContext.statusTracker().getActiveJobsIds()


def test_a_slow_check_is_incomplete_and_leaves_no_job(spark):
    slow = F.udf(lambda i: time.sleep(0.5) or i, "long")
    checks = {
        "two": lambda: rows(spark, 2), "slow": lambda: rows(spark, 400).repartition(4).withColumn("path", slow("path")),
        "none": lambda: rows(spark, 0), "broken": lambda: spark.table("no_such_table"), "three": lambda: rows(spark, 3),
    }
    began = time.monotonic()
    got = deadline.within(spark, checks, SCHEMA, 6)
    assert time.monotonic() - began < 25
    status = [(r.check, r.status) for r in got.statuses.orderBy("ord").collect()]
    assert status == [("two", "completed"), ("slow", "incomplete"), ("none", "completed"), ("broken", "skipped"), ("three", "completed")]
    assert got.statuses.where("check = 'broken'").first().reason.startswith("Falló la verificación: [TABLE_OR_VIEW_NOT_FOUND]")
    assert {r["check"]: r["count"] for r in got.findings.groupBy("check").count().collect()} == {"two": 2, "three": 3}
    for _ in range(50):
        if not running(spark):
            break
        time.sleep(0.1)
    assert not running(spark)


def test_no_time_and_no_checks(spark):
    got = deadline.within(spark, {"late": lambda: time.sleep(1) or rows(spark, 1)}, SCHEMA, 0)
    assert [(r.status, r.reason) for r in got.statuses.collect()] == [("incomplete", None)] and got.findings.count() == 0
    assert deadline.within(spark, {}, SCHEMA, 1).statuses.count() == 0


@pytest.mark.parametrize("seconds", [60])
def test_all_in_time(spark, seconds):
    got = deadline.within(spark, {"a": lambda: rows(spark, 5), "b": lambda: rows(spark, 1)}, SCHEMA, seconds)
    assert got.findings.count() == 6 and set(got.seconds) == {"a", "b"} and got.statuses.where("status = 'completed'").count() == 2
