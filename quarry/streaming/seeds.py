"""Streams of findings, seeds and animations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.events import translated
from ..functions.findings import TRANSITIONS
from ..operators.seeds import create

_OUT = "seed_id string, seq long, new_state string, accepted boolean, state string"
#: Animations that hold, and for how many milliseconds.
HELD, HOLD = ("analysis-complete", "celebration"), 3000


def seed_stream(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A seed for each finding of a stream; ids follow from findings, so replays make the same ones."""
    return create(findings, keys)


def event_stream(bus: DataFrame) -> DataFrame:
    """Wire events of a bus's events (seq, type, payload), batch or stream; ``seq`` is the order of what was emitted."""
    return bus.select("seq", translated(F.col("type"), F.col("payload")).alias("event")).where("event IS NOT NULL")


def transition_stream(requests: DataFrame) -> DataFrame:
    """Requests (seed_id, seq, new_state) of a stream with whether each was accepted, by a state kept per seed.

    Requests of a seed are taken in the order of seq within a batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "Pendiente"
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            accepted = r.new_state in TRANSITIONS[now]
            now = r.new_state if accepted else now
            out.append((key[0], r.seq, r.new_state, accepted, now))
        state.update((now,))
        yield pd.DataFrame(out, columns=["seed_id", "seq", "new_state", "accepted", "state"])

    return requests.groupBy("seed_id").applyInPandasWithState(step, _OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def animations(requests: DataFrame) -> DataFrame:
    """When each requested animation (mascot, at in ms, animation) starts to show, in order; idle after a held one ends.

    One is shown at a time, first come first shown. Held ones stay for a fixed time; others until the next request.
    """

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        free, out = None, []
        for r in pdf.sort_values(["at", "seq"]).itertuples(index=False):
            if free is not None and r.at > free:
                out.append((r.mascot, free, "idle"))
                free = None
            start = r.at if free is None else max(free, r.at)
            out.append((r.mascot, start, r.animation))
            free = start + HOLD if r.animation in HELD else (None if free is None or start >= free else free)
        if free is not None:
            out.append((pdf["mascot"].iloc[0], free, "idle"))
        return pd.DataFrame(out, columns=["mascot", "at", "animation"])

    return requests.groupBy("mascot").applyInPandas(play, "mascot string, at long, animation string")
