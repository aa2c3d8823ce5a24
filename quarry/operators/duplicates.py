"""Duplicate blocks: greedy pairs of similar windows, without all pairs and without a task that sees a whole length class.

Windows are taken in order; each that is still free takes the next free one that is similar and doesn't overlap it. Similar
windows agree on four of five lines, so they share a key: the window without one line. Windows of equal lines are a class,
and keys are made once for each class.

*A class that shares no key with another* pairs its own windows only. A window then takes the oldest free one before it, or
waits: first come, first served, so the t-th that waits pairs with the t-th that takes. How many wait is all that passes
from one file to the next, five at most; so ranges of files are run for every such number at once, and the ranges' maps
from numbers to numbers are composed. That holds for a class of any size.

*Other classes* are joined to components by the keys they share. A pass in order through a component keeps, for each key,
the free windows (all overlap each other, so there are five at most). Components too large for a task are paired in rounds:
a pair is taken if it comes first among all pairs that touch either of its windows, which gives the same pairs.
"""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Workspace, workspace
from .lines import WINDOW, digests

log = logging.getLogger(__name__)

#: Windows of a component that one task pairs; larger components are paired in rounds.
COMPONENT = 1_000_000
#: Windows that wait at a time, at most: those that overlap each other.
WAITING = WINDOW
#: Parts that a key's windows are dealt into before the first ones are taken.
SALT = 32


# ---- classes by themselves


class _Queue:
    """Windows of a class that wait, where ``before`` of them are of earlier files."""

    __slots__ = ("before", "own", "taken", "waited")

    def __init__(self, before: int) -> None:
        self.before, self.own, self.waited, self.taken = before, deque(), 0, 0

    def next_file(self) -> None:
        self.before += len(self.own)
        self.own.clear()

    def pairs(self, start: int) -> bool:
        """Whether the window at ``start`` takes one that waits; else it waits."""
        if self.before:
            self.before -= 1
        elif self.own and self.own[0] + WINDOW <= start:
            self.own.popleft()
        else:
            self.own.append(start)
            self.waited += 1
            return False
        self.taken += 1
        return True


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows by part and class, in order: the first two columns, and an iterator over rows, to be read before the next."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held = next(rows, None)
    while held is not None:
        key, first = held[:2], held
        held = None

        def own() -> Iterator[tuple]:
            nonlocal held
            yield first  # noqa: B023
            for row in rows:
                if row[:2] != key:  # noqa: B023
                    held = row
                    return
                yield row

        yield key, own()


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (part, cls), rows in _runs(batches):
        queues, file = [_Queue(k) for k in range(WAITING + 1)], None
        for at, (_, _, path, start) in enumerate(rows):
            for q in queues:
                if at and path != file:
                    q.next_file()
                q.pairs(start)
            file = path
        columns = [[part], [cls], [[q.before + len(q.own) for q in queues]], [[q.waited for q in queues]], [[q.taken for q in queues]]]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "cls", "after", "waited", "taken"), (c[0] for c in columns), strict=True))], schema=_MAP)


_MAP = pa.schema([("part", pa.int32()), ("cls", pa.binary()), ("after", pa.list_(pa.int64())), ("waited", pa.list_(pa.int64())), ("taken", pa.list_(pa.int64()))])


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """What each range of a class starts with: how many wait, and how many have waited and taken before."""
    k = waited = taken = 0
    out = []
    for r in pdf.sort_values("part").itertuples(index=False):
        out.append((r.part, r.cls, k, waited, taken))
        k, waited, taken = r.after[k], waited + r.waited[k], taken + r.taken[k]
    return pd.DataFrame(out, columns=["part", "cls", "before", "waited", "taken"])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch_rows in _chunks(_turn_rows(batches)):
        cls, path, start, takes, turn = zip(*batch_rows, strict=True)
        names = ["cls", "path", "start_line", "takes", "turn"]
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(path), pa.array(start, pa.int32()), pa.array(takes), pa.array(turn, pa.int64())], names=names)


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for (_, cls), rows in _runs(batches):
        queue = file = None
        waited = taken = 0
        for _, _, path, start, before, waited0, taken0 in rows:
            if queue is None:
                queue, waited, taken = _Queue(before), waited0, taken0
            elif path != file:
                queue.next_file()
            file = path
            takes = queue.pairs(start)
            yield cls, path, start, takes, (taken + queue.taken if takes else waited + queue.waited)


def _chunks(rows: Iterator[tuple], size: int = 8192) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _alone(rows: DataFrame, work: Workspace) -> DataFrame:
    """Pairs of windows of equal lines. Input: cls, path, start_line of classes that share no key with another."""
    spark, kind = rows.sparkSession, rows.schema["path"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.settle(rows.repartitionByRange(n, "cls", "path").withColumn("part", F.spark_partition_id()))
    ordered = lambda df: df.repartition("part").sortWithinPartitions("part", "cls", "path", "start_line")
    maps = work.settle(ordered(dealt).select("part", "cls", "path", "start_line").mapInArrow(_maps, "part int, cls binary, after array<long>, waited array<long>, taken array<long>"))
    wide = maps.groupBy("cls").count().where("count > 1").select("cls")
    starts = maps.join(wide, "cls", "left_semi").groupBy("cls").applyInPandas(_composed, "part int, cls binary, before long, waited long, taken long")
    # a class that goes on in another range is the last of its own: two rows for each range at most
    begun = dealt.join(F.broadcast(starts), ["part", "cls"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    turns = work.settle(ordered(begun).select("part", "cls", "path", "start_line", zero("before"), zero("waited"), zero("taken")).mapInArrow(_turns, f"cls binary, path {kind}, start_line int, takes boolean, turn long"))
    side = lambda takes, s: turns.where("takes" if takes else "NOT takes").select("cls", "turn", *[F.col(c).alias(f"{s}_{c}") for c in ("path", "start_line")])
    return side(False, "a").join(side(True, "b"), ["cls", "turn"]).select("a_path", "a_start_line", "b_path", "b_start_line", F.lit(WINDOW).alias("equal_lines"))


# ---- classes that share keys


def _components(shared: DataFrame, work: Workspace) -> DataFrame:
    """cls, comp: the least class that is reached through shared keys. Input: cls, key.

    A round takes the least label under each key and then the label's own label; it needs few of them.
    """
    labels = work.settle(shared.select("cls", F.col("cls").alias("comp")).distinct())
    for turn in range(1, 1000):
        before = work.made
        least = shared.join(labels, "cls").groupBy("key").agg(F.min("comp").alias("comp"))
        near = shared.join(least, "key").groupBy("cls").agg(F.min("comp").alias("comp"))
        jump = labels.select(F.col("cls").alias("at"), F.col("comp").alias("further"))
        after = near.join(jump, F.col("comp") == F.col("at"), "left").select("cls", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
        new = work.settle(after)
        changed = new.join(labels.withColumnRenamed("comp", "old"), "cls").where("comp <> old").count()
        log.info("components, round %d: %d labels changed", turn, changed)
        labels = new
        work.forget(before)
        if not changed:
            return labels
    raise RuntimeError("labels of components did not settle")


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a_path", "a_start_line", "b_path", "b_start_line", "equal_lines"]
    for chunk in _chunks(_passed(batches)):
        a, i, b, j, n = zip(*chunk, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(i, pa.int32()), pa.array(b), pa.array(j, pa.int32()), pa.array(n, pa.int32())], names=names)


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pairs of a component, from its windows in order: each takes the first free one before it that is similar."""
    component, free = None, {}
    at = 0
    for batch in batches:
        for comp, path, start, cls, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if comp != component:
                component, free = comp, {}
            at += 1
            best = None
            for key in keys:
                for other in free.get(key, ()):
                    if (other[1] != path or other[2] + WINDOW <= start) and (best is None or other[0] < best[0]):
                        best = other
            if best is None:
                me = (at, path, start, cls, keys)
                for key in keys:
                    free.setdefault(key, []).append(me)
                continue
            for key in best[4]:
                free[key].remove(best)
            yield best[1], best[2], path, start, WINDOW if best[3] == cls else WINDOW - 1


def in_rounds(rows: DataFrame, work: Workspace) -> DataFrame:
    """Pairs of windows (path, start_line, cls, keys), taken in rounds.

    A pair comes first among all that touch its windows exactly if each is the other's first similar free window. A window's
    first one is among the first ten of one of its keys: no more than nine overlap it.
    """
    kind = rows.schema["path"].dataType.simpleString()
    place, most = F.struct("path", "start_line"), 2 * WINDOW
    live = work.settle(rows)
    taken = []
    turn = 0
    while True:
        turn += 1
        before = work.made
        under = live.select("path", "start_line", "cls", F.explode("keys").alias("key"))
        salt = F.pmod(F.xxhash64("path", "start_line"), F.lit(SALT))
        some = under.withColumn("n", F.row_number().over(Window.partitionBy("key", salt).orderBy("path", "start_line"))).where(F.col("n") <= most)
        first = some.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("path", "start_line"))).where(F.col("n") <= most)
        heads = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("path", "start_line", "cls"))).alias("heads"))
        apart = lambda x: (x["path"] != F.col("path")) | (F.abs(x["start_line"] - F.col("start_line")) >= WINDOW)
        own = under.join(heads, "key").select("path", "start_line", "cls", F.get(F.filter("heads", apart), F.lit(0)).alias("to")).where("to IS NOT NULL")
        wanted = work.settle(own.groupBy("path", "start_line").agg(F.min("to").alias("to"), F.first("cls").alias("cls")))
        back = wanted.select(F.col("to.path").alias("path"), F.col("to.start_line").alias("start_line"), F.col("path").alias("b_path"), F.col("start_line").alias("b_start_line"), F.col("cls").alias("b_cls"))
        mutual = wanted.join(back, ["path", "start_line"]).where((F.col("to.path") == F.col("b_path")) & (F.col("to.start_line") == F.col("b_start_line")))
        equal = F.when(F.col("cls") == F.col("b_cls"), WINDOW).otherwise(WINDOW - 1)
        pairs = work.settle(mutual.where(place < F.struct(F.col("b_path").alias("path"), F.col("b_start_line").alias("start_line"))).select(F.col("path").alias("a_path"), F.col("start_line").alias("a_start_line"), "b_path", "b_start_line", equal.alias("equal_lines")))
        found = pairs.count()
        log.info("duplicate blocks, round %d: %d pairs", turn, found)
        if not found:
            break
        taken.append(pairs)
        gone = pairs.select(F.col("a_path").alias("path"), F.col("a_start_line").alias("start_line")).union(pairs.select("b_path", "b_start_line"))
        # who has no similar window free will not get one
        live = work.settle(live.join(wanted.select("path", "start_line"), ["path", "start_line"], "left_semi").join(gone, ["path", "start_line"], "left_anti"))
        work.forget(before)
    out = rows.sparkSession.createDataFrame([], f"a_path {kind}, a_start_line int, b_path {kind}, b_start_line int, equal_lines int")
    for t in taken:
        out = out.unionByName(t)
    return out


def duplicate_blocks(w: DataFrame, most: int = COMPONENT) -> DataFrame:
    """Duplicate blocks, each window in one at most: a_path, a_start_line, a_end_line, b_path, b_start_line, b_end_line,
    equal_lines. Input: lines.windows().

    Pairs are those of a pass through all windows of a length class in the order of path and line. No windows: no rows.
    """
    spark, kind = w.sparkSession, w.schema["path"].dataType.simpleString()
    with workspace(spark, "duplicates") as work:
        rows = work.settle(digests(w).select("path", "start_line", "cls", "keys"))
        classes = work.settle(rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")))
        edges = classes.select("cls", F.explode("keys").alias("key"))
        shared = work.settle(edges.join(edges.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi"))
        alone = classes.where("n > 1").select("cls").join(shared, "cls", "left_anti")
        pairs = _alone(rows.join(alone, "cls", "left_semi").select("cls", "path", "start_line"), work)
        met = rows.join(_components(shared, work), "cls")
        large = work.settle(met.groupBy("comp").count().where(F.col("count") > most).select("comp"))
        small = met.join(large, "comp", "left_anti").repartition("comp").sortWithinPartitions("comp", "path", "start_line")
        schema = f"a_path {kind}, a_start_line int, b_path {kind}, b_start_line int, equal_lines int"
        pairs = pairs.unionByName(small.select("comp", "path", "start_line", "cls", "keys").mapInArrow(_pass, schema))
        if not large.isEmpty():
            pairs = pairs.unionByName(in_rounds(met.join(large, "comp", "left_semi").select("path", "start_line", "cls", "keys"), work))
        path = f"{work.top}-pairs"
        pairs.write.option("compression", "zstd").parquet(path)
    end = lambda s: (F.col(f"{s}_start_line") + WINDOW - 1).alias(f"{s}_end_line")
    return spark.read.schema(pairs.schema).parquet(path).select("a_path", "a_start_line", end("a"), "b_path", "b_start_line", end("b"), "equal_lines")
