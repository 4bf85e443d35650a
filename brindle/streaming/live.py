"""The session state machine on a stream, and event-time windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import sessions


class SessionProcessor(StatefulProcessor):
    """Holds one bounded state a session; with ``idle_ms`` it expires after so long without a turn."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "body string", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else sessions.fresh()
        out = []
        for row in pd.concat(list(rows)).sort_values("turn", kind="stable").to_dict("records"):
            state = sessions.step(state, row | {"categories": list(row["categories"])})
            out.append(sessions.view(state, row["session"], row["turn"]))
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def live_sessions(turns: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Streaming (session, turn, text) to the state after every turn, as the batch fold gives it.

    A stream that never ends should bound its state with ``idle_ms``.
    """
    signals = sessions.turn_signals(turns)
    mode = "ProcessingTime" if idle_ms else "None"
    return sessions.spelled(signals.groupBy("session").transformWithStateInPandas(SessionProcessor(idle_ms), sessions.FOLDED, "Append", mode))


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events whose ``ts`` is an instant (zoneless times are taken in the session's zone), with a watermark on streams."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and value sums by event type in tumbling or sliding windows, on a stream or a table."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    source = _timed(events, late)
    return source.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a user's events that are less than ``gap`` apart."""
    source = _timed(events, late)
    w = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
