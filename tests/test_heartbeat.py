"""Silences of a stream of signs against all signs at once."""

import datetime
import random

import pandas as pd
import pytest

from quarry.streaming import heartbeat

ZERO = datetime.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    source, out = f"file://{tmp_path}/signs", []
    for k, v in heartbeat.SETTINGS.items():
        spark.conf.set(k, v)

    def run(rows, silence, delay):
        """Add a batch of (sender, ms) and run the stream over it."""
        made = [(s, ZERO + datetime.timedelta(milliseconds=ms)) for s, ms in rows]
        spark.createDataFrame(made, "sender long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = heartbeat.silences(spark.readStream.schema("sender long, ts timestamp").parquet(source), silence, delay)
        keep = lambda df, _: out.extend(map(tuple, df.collect()))
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        start = int(ZERO.replace(tzinfo=datetime.UTC).timestamp() * 1000)
        return sorted((s, a - start, b - start, n) for s, a, b, n in out)

    yield run
    for k in heartbeat.SETTINGS:
        spark.conf.unset(k)


def expected(rows, silence, watermark):
    out = []
    for s in {s for s, _ in rows}:
        times = sorted({t for q, t in rows if q == s})
        lost = [t for t, after in zip(times, [*times[1:], None], strict=True) if (after is None or after - t > silence) and t + silence <= watermark]
        out += [(s, t, t + silence, n + 1) for n, t in enumerate(lost)]
    return sorted(out)


def test_signs_in_any_order_within_the_delay(feed):
    rng = random.Random(6)
    rows, got = [], []
    for batch in range(3):
        # times of a batch overlap those of the batches before by less than the delay
        new = [(rng.randint(1, 5), batch * 10_000 + rng.randint(-1500, 10_000)) for _ in range(25)] + [(9, batch * 10_000 + 9_990)]
        new = [(s, max(t, 0)) for s, t in new]
        rows += [*new, new[0]]
        got = feed([*new, new[0]], 2000, "3 seconds")
    assert got == expected(rows, 2000, max(t for _, t in rows) - 3000) and len(got) > 10


def test_late_signs_are_left_out(feed):
    feed([(1, 0), (2, 50_000)], 1000, "5 seconds")
    got = feed([(1, 500), (1, 46_000), (2, 70_000)], 1000, "5 seconds")
    assert got == [(1, 0, 1000, 1), (1, 46_000, 47_000, 2), (2, 50_000, 51_000, 1)]


def test_calls_to_the_state_grow_with_batches_and_not_with_signs_or_senders():
    calls = []

    class Handle:
        value = None

        def getValueState(self, *_):  # noqa: N802
            return self

        getListState = getValueState  # noqa: N815

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def __getattr__(self, name):
            def call(x=None):
                calls.append(name)
                if name == "update":
                    self.value = x

            return call

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 1_000_500

        getExpiryTimeInMs = lambda self: 1000  # noqa: E731, N815

    kept = heartbeat._Silence(1000)
    kept.init(Handle())
    signs = [(s, t + s) for t in range(0, 2_000_000, 200) if t % 100_000 < 50_000 for s in (5, 7)]
    rng = random.Random(7)
    rng.shuffle(signs)
    frame = lambda rows: pd.DataFrame(rows, columns=["sender", "at"])
    list(kept.handleInputRows((1, False), iter([frame(signs[:4000]), frame(signs[4000:] + signs[:9])]), Now()))
    (got,) = kept.handleExpiredTimer((1, False), Now(), Now())
    assert [tuple(r) for r in got.itertuples(index=False)] == [(s, 100_000 * i + 49_800 + s, 100_000 * i + 50_800 + s, i + 1) for s in (5, 7) for i in range(10)]
    Now.getCurrentWatermarkInMs = lambda self: 1_100_500
    (got,) = kept.handleExpiredTimer((1, False), Now(), Now())
    assert [tuple(r) for r in got.itertuples(index=False)] == [(s, 1_049_800 + s, 1_050_800 + s, 11) for s in (5, 7)]
    assert len(calls) <= 6
