"""Who has fallen silent: a stream of signs of life, with a state and timers for each sender."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..sources.tables import shared_folder

#: Fixed value: milliseconds without a sign after which a connection counts as lost.
SILENCE = 30_000
#: What a session needs to run these streams.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Groups of senders that share a state, so that calls to it grow with these and with batches, and not with senders and signs.
GROUPS = 1024


class _Silence(StatefulProcessor):
    """Keeps the times of signs until it is known whether another follows in time.

    When the watermark has passed the end of a sign's time, no sign before that can come any more: if none is kept that lies
    within this time, it was the last for too long. So the order in which signs come doesn't matter, and no more are kept
    than lie within the silence and the watermark's delay. A group of senders has one timer, for its first sign that isn't
    settled, and one value: signs (sender, time) in order, and how often each sender was lost.
    """

    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", StructType([StructField("signs", BinaryType()), StructField("lost", BinaryType())]))

    def _held(self) -> list[np.ndarray]:
        return [np.frombuffer(bytes(x), "<i8").reshape(2, -1) for x in (self.kept.get() if self.kept.exists() else (b"", b""))]

    def _keep(self, signs: np.ndarray, lost: np.ndarray) -> None:
        self.kept.update(tuple(np.ascontiguousarray(x, "<i8").tobytes() for x in (signs, lost)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, lost = self._held()
        signs = np.concatenate([before, *[np.stack([frame[c].to_numpy(np.int64) for c in ("sender", "at")]) for frame in rows]], axis=1)
        signs = signs[:, np.lexsort(signs[::-1])]
        signs = signs[:, np.append(True, (signs[:, 1:] != signs[:, :-1]).any(axis=0))]  # equal signs count once
        first, was = int(signs[1].min()), int(before[1].min()) if before.size else None
        self._keep(signs, lost)
        if was is None or first < was:
            if was is not None:
                self.handle.deleteTimer(was + self.silence)
            self.handle.registerTimer(first + self.silence)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        signs, lost = self._held()
        sender, at = signs
        follows = np.append((sender[1:] == sender[:-1]) & (at[1:] - at[:-1] <= self.silence), False)
        ended = at + self.silence <= timerValues.getCurrentWatermarkInMs()
        who, seen = signs[:, ended & ~follows]
        names, place, own = np.unique(who, return_index=True, return_counts=True)
        counts = dict(zip(*lost.tolist(), strict=True))
        before = np.array([counts.get(x, 0) for x in names.tolist()], np.int64)
        counts.update(zip(names.tolist(), (before + own).tolist(), strict=True))
        self._keep(signs[:, ~ended], np.array([[*counts], [*counts.values()]], np.int64))
        if not ended.all():
            self.handle.registerTimer(int(at[~ended].min()) + self.silence)
        if len(who):
            times = np.arange(len(who)) - np.repeat(place - before - 1, own)
            whose = pd.array([None] * len(who) if key[1] else who, "Int64")
            yield pd.DataFrame({"sender": whose, "last_seen": seen, "lost_at": seen + self.silence, "times_lost": times})

    def close(self) -> None:
        pass


def silences(signs: DataFrame, silence: int = SILENCE, delay: str = "10 seconds") -> DataFrame:
    """sender, last_seen, lost_at (ms) and times_lost of each time that a sender fell silent, as a stream.

    Input: a stream with sender (a long) and ts (a timestamp, of which milliseconds count). A sign may come late by ``delay``;
    what comes later than that is left out. Equal signs count once. A sender is lost once the watermark has passed the end of
    its time, so the last signs of a stream are open.
    """
    whose = [F.pmod(F.xxhash64("sender"), F.lit(GROUPS)).alias("part"), F.col("sender").isNull().alias("none"), F.coalesce("sender", F.lit(0)).cast("long").alias("sender")]
    rows = signs.where("ts IS NOT NULL").withWatermark("ts", delay).select(*whose, "ts", F.unix_millis("ts").alias("at"))
    out = "sender long, last_seen long, lost_at long, times_lost long"
    return rows.groupBy("part", "none").transformWithStateInPandas(_Silence(silence), out, "append", "eventTime")


def silences_of(batches: list[DataFrame], silence: int = SILENCE, delay: str = "10 seconds") -> DataFrame:
    """silences() of tables (sender, ts) that come one after the other, each as a run of one stream that keeps its state."""
    spark = batches[0].sparkSession
    top = shared_folder(spark, "silences")
    schema = "sender long, ts timestamp"
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        for batch in batches:
            batch.select(F.col("sender").cast("long").alias("sender"), F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{top}/signs")
            found = silences(spark.readStream.schema(schema).parquet(f"{top}/signs"), silence, delay)
            keep = lambda df, n: df.write.mode("overwrite").parquet(f"{top}/lost/batch={n}")
            run = found.writeStream.foreachBatch(keep).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema("sender long, last_seen long, lost_at long, times_lost long").parquet(f"{top}/lost").drop("batch")
