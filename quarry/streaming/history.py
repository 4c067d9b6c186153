"""Causal entity history on streams: the batch operator's unlimited window, kept up event by event.

Events of one time are held back until a later event of the entity, or the watermark, shows that the time is over, so
that they never see each other. Events later than the watermark are dropped, as a batch result would change by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "entity string, rid long, t double, value double, hist_count double, hist_sum double, hist_mean double, hist_std double, hist_last double, hist_deviation double, hist_time_since double"
STATE = "n long, total double, squares double, last_value double, last_t double, held_t array<double>, held_rid array<long>, held_value array<double>"


class Running:
    """Sums of an entity's finished events and the events whose time may still grow."""

    def __init__(self, state: tuple | None = None):
        self.n, self.total, self.squares, self.last_value, self.last_t, *held = state or (0, 0.0, 0.0, 0.0, -math.inf, [], [], [])
        self.held = sorted(zip(*held, strict=True)) if held[0] else []

    def tuple(self) -> tuple:
        t, rid, v = zip(*self.held, strict=True) if self.held else ([], [], [])
        return self.n, self.total, self.squares, self.last_value, self.last_t, list(t), list(rid), list(v)

    def release(self, before: float) -> list[tuple]:
        """Rows of all held events earlier than ``before``, time by time."""
        out: list[tuple] = []
        while self.held and self.held[0][0] < before:
            t = self.held[0][0]
            group = [h for h in self.held if h[0] == t]
            self.held = self.held[len(group) :]
            mean = self.total / self.n if self.n else 0.0
            std = math.sqrt(max(self.squares / self.n - mean * mean, 0.0)) if self.n else 0.0
            for _, rid, v in group:
                seen = (self.total, mean, std, self.last_value, v - mean, t - self.last_t) if self.n else (0.0, 0.0, 0.0, 0.0, 0.0, -1.0)
                out.append((rid, t, v, float(self.n), *seen))
            for _, _, v in group:
                self.n, self.total, self.squares, self.last_value, self.last_t = self.n + 1, self.total + v, self.squares + v * v, v, t
        return out


def update(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
    """One entity's step: new events join the held ones; those before the watermark come out with their history."""
    import pandas as pd

    run = Running(state.get if state.exists else None)
    for pdf in batches:
        run.held += [(float(t), int(r), 0.0 if v is None or v != v else float(v)) for t, r, v in zip(pdf["_t"], pdf["_rid"], pdf["_value"], strict=True)]
    run.held.sort()
    mark = state.getCurrentWatermarkMs() / 1000.0
    rows = run.release(mark)
    state.update(run.tuple())
    if run.held:
        state.setTimeoutTimestamp(int(max(run.held[-1][0], mark) * 1000) + 1)
    yield pd.DataFrame([(str(key[0]), *r) for r in rows], columns=[c.split()[0] for c in OUTPUT.split(", ")])


def stream_history(events: DataFrame, entity: str, time: str, value: str, rid: str, delay: str = "10 minutes") -> DataFrame:
    """History columns of a stream of events, each row once its time is closed by the watermark. time: a timestamp column."""
    rows = events.withWatermark(time, delay).select(F.col(entity).cast("string").alias("_entity"), (F.unix_micros(time) / 1e6).alias("_t"), F.col(value).cast("double").alias("_value"), F.col(rid).cast("long").alias("_rid"), time)
    return rows.groupBy("_entity").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
