"""Session replay as a stream, whose state ends with the session."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.sessions import QUIT

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that ``session_stream`` needs, for queries that are started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _ms(t: timedelta) -> int:
    return t // timedelta(milliseconds=1)


class Replay(StatefulProcessor):
    """One session: the state in force, what the next line is, and one timer at which all that is forgotten."""

    def __init__(self, idle: timedelta, closed: timedelta):
        self.idle, self.closed = _ms(idle), _ms(closed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("session", "state string, expecting boolean, closed boolean, latest long, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values(["at", "turn_id"])
        start = lines["start_state"].iloc[0]
        start = None if pd.isna(start) else start
        state, expecting, closed, latest, due = self.kept.get() if self.kept.exists() else (start, start is None, False, None, None)
        if due is not None and due <= timerValues.getCurrentWatermarkInMs():  # a batch's timers come behind its rows
            self.handle.deleteTimer(due)
            state, expecting, closed, latest, due = start, start is None, False, None, None
        out = []
        for turn_id, player in zip(lines["turn_id"], lines["player"]):
            line = (player or "").strip()
            said, now = line.lower(), state
            if closed:
                kind = "ignored"
            elif expecting:
                kind, state, expecting = "state", line, False
            elif said in QUIT:
                kind, closed = "quit", True
            elif said == "/state":
                kind, expecting = "state_command", True
            else:
                kind = "blank" if not line else "show" if said == "/show" else "turn"
            out.append((key[0], turn_id, kind, now))
        newest = lines["at"].max()
        times = [t for t in (latest, None if pd.isna(newest) else int(newest) // 1000) if t is not None]
        latest = max(times, default=timerValues.getCurrentWatermarkInMs())
        then = latest + (self.closed if closed else self.idle)
        if then != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(then)
        self.kept.update((state, expecting, closed, latest, then))
        yield pd.DataFrame(out, columns=["session_id", "turn_id", "kind", "state"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def session_stream(turns: DataFrame, delay: str = "1 hour", idle: timedelta = timedelta(days=1), closed: timedelta = timedelta(hours=1)) -> DataFrame:
    """``session_id, turn_id, kind, state`` of a stream of ``session_id, ts, turn_id, player, start_state``.

    Lines of a micro-batch are taken in order of time and turn (a session's lines of one batch
    are sorted in memory: bound batches by ``maxFilesPerTrigger`` or the like); a line that comes
    in a later batch is taken then, even if its time lies before what was taken. A session is
    forgotten when the watermark, ``delay`` behind the newest time, has passed its last line by
    ``idle``, or by ``closed`` where it was quit; a line behind that begins it anew, from its own
    ``start_state``. A line older than the watermark is dropped without a row; Spark counts those
    as ``numRowsDroppedByWatermark``. A line without a time is the first of its batch and doesn't
    keep its session alive. Start the query inside ``rocksdb``.
    """
    timed = turns.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select("session_id", "ts", F.unix_micros("ts").alias("at"), "turn_id", "player", "start_state")
    return rows.groupBy("session_id").transformWithStateInPandas(Replay(idle, closed), "session_id long, turn_id long, kind string, state string", "append", "eventTime")
