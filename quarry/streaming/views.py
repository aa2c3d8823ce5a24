"""Derived tables of an index, kept up from changes alone.

Every table is a log of weighted rows: a batch adds rows with weights, positive for what came and negative for what went, and
a row is there as long as its weights don't add up to nothing. What a batch changes follows from the changed paths, what the
logs hold of them, and, since a file that comes or goes may be what others import, the imports of its name: edges are imports
times the targets of names, so that what changes them is changed imports by all targets and old imports by changed targets.
Logs are dealt into buckets by what they are looked up by, and a batch reads no other buckets than those of its own rows.

Logs: ``files`` by the names that an import may have for them, ``imports`` by importing path and ``importers`` (the same
rows) by imported name, ``edges`` by importing path, ``degrees`` of imported files, ``words`` (a file's in order, repeats kept,
as one row) of paths, ``totals`` of words.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import is_test
from ..functions.text import tokens
from ..operators.graph import names_of
from ..sources.tables import Workspace, delete, workspace
from .index import latest

#: Batches after which a log's rows are added up into one version.
MERGE = 16


@dataclass(frozen=True)
class Log:
    """A table of weighted rows at ``top``: columns, weights, and the column whose hash tells the bucket."""

    spark: SparkSession
    top: str
    columns: str
    weights: tuple[str, ...]
    by: str
    buckets: int

    @property
    def keys(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(", ")]

    @property
    def schema(self) -> str:
        return ", ".join([self.columns, *[f"{w} long" for w in self.weights]])

    def bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def added(self, rows: DataFrame) -> DataFrame:
        """Rows with their weights added up; those that come to nothing are gone."""
        sums = rows.groupBy(*self.keys).agg(*[F.sum(w).cast("long").alias(w) for w in self.weights])
        return sums.where(" OR ".join(f"{w} <> 0" for w in self.weights))

    def versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in names if n.startswith("version=") and fs.exists(at.suffix(f"/{n}/_SUCCESS"))]
        return sorted(int(n[8:]) for n in done)

    def rows(self, before: int, buckets: list[int] | None = None) -> DataFrame:
        """All weighted rows of versions before one, of some buckets or all."""
        found = [v for v in self.versions() if v < before]
        bases = [v for v in found if v % 2]  # a merged version stands for all before it
        found = [v for v in found if not bases or v >= bases[-1]]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", self.top)
        rows = read.parquet(*[f"{self.top}/version={v}" for v in found])
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*self.keys, *self.weights)

    def none_before(self, version: int) -> bool:
        return not any(v < version for v in self.versions())

    def write(self, version: int, rows: DataFrame, where_they_lie: bool = False) -> DataFrame:
        """Write rows by bucket, brought together first or by each task for itself; gives them as written."""
        dealt = rows.select(*self.keys, *self.weights, self.bucket(self.by).alias("bucket"))
        dealt = dealt if where_they_lie else dealt.repartition("bucket")
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.top}/version={version}")
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.top}/version={version}").drop("bucket")

    def merge(self, version: int) -> None:
        """Add up all versions up to one into the next; what it replaces goes once it is written."""
        if version + 1 not in self.versions():
            self.write(version + 1, self.added(self.rows(version + 1)))
        for old in self.versions():
            if old <= version:
                delete(self.spark, f"{self.top}/version={old}")


class Views:
    """Edges, orphans and word counts of a changing set of files, at ``top``.

    ``imports`` gives path, seq and stem (the imported name, as a path) of files (path, content).
    """

    def __init__(self, spark: SparkSession, top: str, imports: Callable[[DataFrame], DataFrame], buckets: int = 16, merge: int = MERGE) -> None:
        self.spark, self.imports_of, self.merge_after = spark, imports, merge

        def log(name: str, columns: str, by: str, weights: tuple[str, ...] = ("n",)) -> Log:
            return Log(spark, f"{top}/{name}", columns, weights, by, buckets)

        self.files = log("files", "stem string, path string, rank int", "stem")
        self.imports = log("imports", "path string, seq long, stem string", "path")
        self.importers = log("importers", "path string, seq long, stem string", "stem")
        self.edges = log("edges", "path string, seq long, target string", "path")
        self.degrees = log("degrees", "target string", "target")
        self.words = log("words", "path string, words string", "path")
        self.totals = log("totals", "token string", "token", ("n_real", "n_test"))
        self.logs = (self.files, self.imports, self.importers, self.edges, self.degrees, self.words, self.totals)

    @staticmethod
    def _buckets(log: Log, rows: DataFrame, column: str) -> list[int]:
        """The buckets in which a log holds what some rows name: at most as many as it has."""
        return [r[0] for r in rows.select(log.bucket(column)).distinct().collect()]

    def update(self, changes: DataFrame, batch: int) -> None:
        """Apply a batch of changes (seq, path, change_type, content). Batches are numbered from 0; one that runs again
        writes the same versions again."""
        version = 2 * batch  # even; odd ones are merged
        merging = (batch + 1) % self.merge_after == 0
        if not (merging and any(version + 1 in log.versions() for log in self.logs)):  # else a merge was cut short: all is written
            self._apply(changes, version)
        if merging:
            for log in self.logs:
                log.merge(version)

    def _latest(self, changes: DataFrame, work: Workspace) -> DataFrame:
        """latest(): texts are shuffled only of paths that change more than once."""
        again = work.settle(changes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path"))
        if again.isEmpty():
            return work.settle(changes.select("path", "change_type", "content"))
        same = F.col("path").eqNullSafe(F.col("of"))
        once = changes.join(again.withColumnRenamed("path", "of"), same, "left_anti").select("path", "change_type", "content")
        return work.settle(once.unionByName(latest(changes.join(again.withColumnRenamed("path", "of"), same, "left_semi"))))

    def _apply(self, changes: DataFrame, version: int) -> None:
        with workspace(self.spark, "views") as work:
            last = self._latest(changes, work)
            paths = work.settle(last.select("path"))
            new = last.where("change_type <> 'delete'").select("path", "content")
            one = F.lit(1).cast("long").alias("n")

            def gone(log: Log) -> DataFrame:
                """What a log holds of the changed paths, with negative weights."""
                held = log.added(log.rows(version, self._buckets(log, paths, "path")).join(paths, "path", "left_semi"))
                return held.select(*log.keys, *[(-F.col(w)).alias(w) for w in log.weights])

            # each file's words are one row, sorted so that equal ones are equal rows
            words = new.select("path", F.array_join(F.sort_array(tokens(F.col("content"))), " ").alias("words"), one)
            words = words if self.words.none_before(version) else gone(self.words).unionByName(words)
            words = self.words.write(version, words, True)
            imports = self.imports_of(new).select("path", F.col("seq").cast("long").alias("seq"), "stem", one)
            imports = imports if self.imports.none_before(version) else self.imports.added(gone(self.imports).unionByName(imports))
            imports = self.imports.write(version, imports, True)
            # files: what a path that changed may be imported as; a path that stays a file changes nothing
            known = paths.select(names_of(F.col("path"))).select("x.*")
            now = new.select(names_of(F.col("path"))).select("x.*").withColumn("n", one)
            files = self.files
            held = files.added(files.rows(version, self._buckets(files, known, "stem"))).join(paths, "path", "left_semi")
            moved = work.settle(files.added(held.withColumn("n", -F.col("n")).unionByName(now)))

            # edges: changed imports by the targets of their names, old imports by names whose target is another one
            def targets(rows: DataFrame) -> DataFrame:
                return files.added(rows).groupBy("stem").agg(F.min_by("path", "rank").alias("target"))

            stems = moved.select("stem").distinct()
            before = work.settle(files.rows(version, self._buckets(files, moved, "stem")).join(stems, "stem", "left_semi"))
            turned = targets(before).withColumn("w", F.lit(-1)).unionByName(targets(before.unionByName(moved)).withColumn("w", F.lit(1)))
            turned = work.settle(turned.groupBy("stem", "target").agg(F.sum("w").alias("w")).where("w <> 0"))
            edges = imports.join(targets(files.rows(version).unionByName(moved)), "stem").select("path", "seq", "target", "n")
            if not self.importers.none_before(version):
                old = self.importers.rows(version, self._buckets(self.importers, turned, "stem")).join(turned, "stem")
                edges = self.edges.added(edges.unionByName(old.select("path", "seq", "target", (F.col("n") * F.col("w")).alias("n"))))
            edges = self.edges.write(version, edges, True)

            real = F.when(is_test(F.col("path")), 0).otherwise(F.col("n"))
            each = words.select(real.alias("n_real"), (F.col("n") - real).alias("n_test"), F.explode(F.split("words", " ")).alias("token")).where("token <> ''")
            written = [
                (self.importers, imports, True), (self.files, moved, False),
                (self.degrees, self.degrees.added(edges.select("target", "n")), False), (self.totals, self.totals.added(each), False),
            ]
            with ThreadPoolExecutor(len(written)) as jobs:  # small jobs side by side
                for done in [jobs.submit(log.write, version, rows, lie) for log, rows, lie in written]:
                    done.result()

    def current_edges(self) -> DataFrame:
        """path, seq, target."""
        return self.edges.added(self.edges.rows(1 << 62)).drop("n")

    def current_totals(self) -> DataFrame:
        """token, n_real, n_test."""
        return self.totals.added(self.totals.rows(1 << 62))

    def current_orphans(self) -> DataFrame:
        """path of files that nothing imports, test files aside."""
        files = self.files.added(self.files.rows(1 << 62)).where("rank = 0").select("path").where(~is_test(F.col("path")))
        used = self.degrees.added(self.degrees.rows(1 << 62)).select(F.col("target").alias("path"))
        return files.join(used, "path", "left_anti")

    def maintain(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply the batches of a stream of changes as they come."""
        return changes.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

