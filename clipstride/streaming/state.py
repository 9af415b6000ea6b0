"""Operators that keep a little state per worker execution, task or download."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from clipstride.functions.lifecycle import STALE_AFTER_SEC, lookup

UPDATES = "job_id long, event_id long, us long, stage string, percent long, message string"
MARKS = "job_id long, event_id long, us long, value long"


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of one micro-batch, by time."""
    return pd.concat(list(frames)).sort_values(["us", "event_id"])


def _plain(value):
    """A null as None; a column of whole numbers with nulls comes as floats."""
    return None if pd.isna(value) else int(value) if isinstance(value, float) else value


class Ending(StatefulProcessor):
    """Remembers one value per job, until ``keep_sec`` of the stream's own time after it was last set."""

    shape = ""

    def __init__(self, keep_sec: float):
        self.keep_ms = int(keep_sec * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.shape}, ends_ms long")

    def recall(self):
        return self.state.get() if self.state.exists() else None

    def remember(self, value: tuple, us: int) -> None:
        if (old := self.recall()) is not None:
            self.handle.deleteTimer(old[-1])
        ends = us // 1000 + self.keep_ms
        self.handle.registerTimer(ends)
        self.state.update((*value, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Throttle(Ending):
    """Passes a change of stage; otherwise nothing repeated and nothing too soon."""

    shape = "us long, stage string, percent long, message string"

    def __init__(self, interval_us: int, keep_sec: float):
        super().__init__(keep_sec)
        self.interval_us = interval_us

    def handleInputRows(self, key, rows, timerValues):
        last = None if (found := self.recall()) is None else tuple(found)[:-1]
        passed = []
        for row in _in_order(rows).itertuples(index=False):
            now = (row.us, row.stage, _plain(row.percent), row.message)
            if last is not None and last[1] == row.stage:
                if last[2:] == now[2:] or row.us - last[0] < self.interval_us:
                    continue
            last = now
            passed.append((key[0], row.event_id, *now))
        if passed:
            self.remember(last, last[0])
            yield pd.DataFrame(passed, columns=["job_id", "event_id", "us", "stage", "percent", "message"])


class HighWaterMark(Ending):
    """Passes only values above everything seen before; a job that comes back after its mark has ended starts anew."""

    shape = "value long"

    def handleInputRows(self, key, rows, timerValues):
        mark = 0 if (found := self.recall()) is None else found[0]
        frame = _in_order(rows)
        before = frame["value"].cummax().shift(1).fillna(mark).clip(lower=mark)
        passed = frame[frame["value"] > before]
        if len(passed):
            self.remember((int(passed["value"].max()),), int(passed["us"].max()))
            yield passed[["job_id", "event_id", "us", "value"]]


#: How long a job that sends nothing is remembered, and how late a row may come.
KEEP_SEC, LATENESS = 7 * 24 * 3600.0, "1 hour"


def _by_job(rows: DataFrame, processor: StatefulProcessor, shape: str, lateness: str) -> DataFrame:
    timed = rows.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", lateness)
    return timed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=shape, outputMode="Append", timeMode="EventTime")


def throttle(updates: DataFrame, interval_us: int = 1_000_000, keep_sec: float = KEEP_SEC, lateness: str = LATENESS) -> DataFrame:
    return _by_job(updates, Throttle(interval_us, keep_sec), UPDATES, lateness)


def high_water_mark(marks: DataFrame, keep_sec: float = KEEP_SEC, lateness: str = LATENESS) -> DataFrame:
    return _by_job(marks, HighWaterMark(keep_sec), MARKS, lateness)


def watchdog(beats: DataFrame, timeout_sec: dict[str, int] = STALE_AFTER_SEC, lateness: str = "0 seconds") -> DataFrame:
    """Reports a task once when its heartbeat stays away for longer than allowed.

    ``beats(task_id, task_type, status, us, ts)``; time is the stream's own. Heartbeats that follow each other in time are a
    session, which ends when none comes any more; what its last one says decides. So the state is Spark's own, without
    a call to Python for each task.
    """
    # Late means strictly later than the timeout, in whole milliseconds.
    hold = F.concat((lookup(F.col("task_type"), timeout_sec).cast("long") * 1000 + 1).cast("string"), F.lit(" milliseconds"))
    newest = F.max(F.struct("us", "status", "task_type")).alias("newest")
    ended = beats.withWatermark("ts", lateness).groupBy(F.session_window("ts", hold), "task_id").agg(newest)
    return ended.where(F.col("newest.status").isin("CLAIMED", "RUNNING")).select(
        "task_id", "newest.task_type", F.col("newest.us").alias("last_heartbeat_us"))
