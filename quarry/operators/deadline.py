"""Checks that run side by side until a deadline, and what they found by then."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Event

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete, shared_folder

COMPLETED, SKIPPED, INCOMPLETE = "completed", "skipped", "incomplete"
#: Fixed value: the reason that is given for a check that failed.
FAILED = "Falló la verificación: "


@dataclass
class Outcome:
    """What came of the checks: their findings as one table with the column ``check``, and (check, status, reason)."""

    findings: DataFrame
    statuses: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


@dataclass
class _Run:
    name: str
    table: str
    tag: str
    done: Event = field(default_factory=Event)
    error: str | None = None
    seconds: float = 0.0


def within(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]], schema: str, seconds: float) -> Outcome:
    """Run checks at once, each from a thread of its own, and stop those that aren't done after so many seconds.

    A check gives a DataFrame of ``schema``, which is written to the shared folder as a whole or not at all, so a check that
    is late leaves no findings and a finished one keeps all. The jobs of late checks are cancelled by their tag; a thread
    that goes on without a job ends on its own, and what it writes is deleted. A check that fails is skipped, with its error
    as the reason. Checks come in the order given.
    """
    top = shared_folder(spark, "checks")
    runs = [_Run(name, f"{top}/{i}", f"check-{i}-{uuid.uuid4().hex}") for i, name in enumerate(checks)]
    late = Event()

    def work(run: _Run) -> None:
        began = time.monotonic()
        spark.addTag(run.tag)
        try:
            found = checks[run.name]().selectExpr(*[c.split()[0] for c in schema.split(", ")])
            if not late.is_set():
                found.write.parquet(run.table)
        except Exception as error:  # noqa: BLE001  a check must not end the others
            run.error = str(error).splitlines()[0] if str(error) else type(error).__name__
        finally:
            spark.removeTag(run.tag)
            run.seconds = time.monotonic() - began
            run.done.set()

    deadline = time.monotonic() + seconds
    threads = [InheritableThread(target=work, args=(run,), daemon=True) for run in runs]
    for t in threads:
        t.start()
    for run in runs:
        run.done.wait(max(0.0, deadline - time.monotonic()))
    finished = [run for run in runs if run.done.is_set()]
    late.set()
    for run in runs:
        if run not in finished:
            spark.interruptTag(run.tag)
    for run, t in zip(runs, threads, strict=True):
        t.join(timeout=10)
        if run not in finished:
            spark.interruptTag(run.tag)  # a job that it began in between
            delete(spark, run.table)

    def status(run: _Run) -> tuple:
        if run not in finished:
            return run.name, INCOMPLETE, None
        return (run.name, SKIPPED, FAILED + run.error) if run.error else (run.name, COMPLETED, None)

    findings = spark.createDataFrame([], f"check string, {schema}")
    for run in finished:
        if not run.error:
            findings = findings.unionByName(spark.read.schema(schema).parquet(run.table).select(F.lit(run.name).alias("check"), "*"))
    statuses = spark.createDataFrame([(i, *status(run)) for i, run in enumerate(runs)], "ord int, check string, status string, reason string")
    return Outcome(findings, statuses, {run.name: run.seconds for run in finished})
