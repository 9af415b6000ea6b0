"""Timelines, phases, previews, progress and counters over the event log.

Events carry ``us``, their time in microseconds, and ``event_id``, which breaks ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipstride.functions import lifecycle as lc
from clipstride.functions.labels import elapsed_label
from clipstride.operators.scan import Running, running

HOUR_US = 3_600_000_000


def _hour() -> Column:
    return F.floor(F.col("us") / F.lit(HOUR_US)).cast("long")


def _in_order() -> list[Column]:
    return [F.col("us"), F.col("event_id")]


def _ends(events: DataFrame) -> DataFrame:
    place = F.struct("us", "event_id")
    return events.groupBy("job_id").agg(F.min(place).alias("first"), F.max(place).alias("last"))


def event_timeline(events: DataFrame) -> DataFrame:
    """Each event with its predecessor, the time between them, and whether it matters.

    The predecessor is a running maximum over (time, id, type): a lag that does not
    need a whole job in one task.
    """
    seen = F.struct("us", "event_id", "event_type")
    linked = running(events, ["job_id"], _hour(), _in_order(), previous=Running("max", seen))
    place = F.struct("us", "event_id")
    return linked.join(_ends(events), "job_id").select(
        "job_id", "event_id", "us", "event_type",
        F.col("previous.event_id").alias("previous_id"),
        F.col("previous.event_type").alias("previous_type"),
        elapsed_label(F.col("previous.us"), F.col("us")).alias("since_previous"),
        (F.upper("event_type").isin(*lc.IMPORTANT_EVENTS) | (place == F.col("first")) | (place == F.col("last")))
        .alias("important"),
    )


def phase_summary(events: DataFrame) -> DataFrame:
    """Per job and phase: first and latest event and the time between them."""
    place = F.struct("us", "event_id", "event_type")
    return (
        events.withColumn("phase", lc.event_phase(F.col("event_type")))
        .where("phase <> 'system'")
        .groupBy("job_id", "phase")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n_events"))
        .select(
            "job_id", "phase", F.array_position(F.array(*map(F.lit, lc.PHASES)), F.col("phase")).alias("position"),
            F.col("last.event_type").alias("latest_type"), F.col("last.us").alias("latest_us"), "n_events",
            elapsed_label(F.col("first.us"), F.col("last.us")).alias("elapsed"),
        )
    )


def event_previews(events: DataFrame, important: int = 7, raw: int = 6) -> DataFrame:
    """The newest important and raw events of each job, and how many are hidden.

    Both rankings have a constant bound, so they are cut before the shuffle.
    """
    place = F.struct("us", "event_id")
    flagged = events.join(_ends(events), "job_id").withColumn(
        "important",
        F.upper("event_type").isin(*lc.IMPORTANT_EVENTS) | (place == F.col("first")) | (place == F.col("last")),
    )
    newest = Window.partitionBy("job_id").orderBy(F.desc("us"), F.desc("event_id"))

    def latest(rows: DataFrame, n: int, name: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n).select(
            "job_id", F.lit(name).alias("list"), F.col("rank").cast("long").alias("rank"), "event_id", "event_type"
        )

    totals = flagged.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if("important").alias("n_important"),
        elapsed_label(F.min("us"), F.max("us")).alias("total_elapsed"),
    )
    shown = latest(flagged.where("important"), important, "important").unionByName(latest(events, raw, "raw"))
    hidden = F.when(F.col("list") == "raw", F.col("n_raw") - raw).otherwise(F.col("n_important") - important)
    return shown.join(totals, "job_id").select(
        "job_id", "list", "rank", "event_id", "event_type",
        F.greatest(hidden, F.lit(0).cast("long")).alias("hidden"), "total_elapsed",
    )


def compact_progress(events: DataFrame, progress: str = "WORKER_PROGRESS", final: tuple[str, ...] = ()) -> DataFrame:
    """Drop progress that a later change of stage, or an end of the job, made obsolete."""
    is_progress = F.col("event_type") == progress
    updates = events.where(is_progress)
    before = running(updates, ["job_id"], _hour(), _in_order(), before=Running("max", F.struct("us", "event_id", "stage")))
    changed = F.col("before").isNull() | (F.col("before.stage") != F.col("stage"))
    place = F.struct("us", "event_id")
    since = before.groupBy("job_id").agg(F.max(F.when(changed, place)).alias("since"))
    ended = events.where(F.col("event_type").isin(*final)).groupBy("job_id").agg(F.max(place).alias("ended"))
    return (
        events.join(since, "job_id", "left").join(ended, "job_id", "left")
        .where(
            ~is_progress
            | ((place >= F.col("since")) & (F.col("ended").isNull() | (place > F.col("ended"))))
        )
        .drop("since", "ended")
    )


def counters(events: DataFrame, metric_of: dict[str, str], tag: Column) -> DataFrame:
    """Events counted per metric and tag; two event types may feed one metric."""
    return (
        events.withColumn("metric", lc.lookup(F.col("event_type"), metric_of)).where("metric is not null")
        .groupBy("metric", tag.alias("tag")).agg(F.count(F.lit(1)).alias("value"))
    )


def throttle_progress(updates: DataFrame, interval_us: int = 1_000_000) -> DataFrame:
    """The updates a throttled sender lets through.

    A change of stage always passes and starts afresh, so each stretch of one stage is
    on its own.  Within it an exact repeat of the last sent update, or one sooner than
    ``interval_us`` after it, is dropped.  That needs only the last sent update:
    stretches are sorted inside partitions and read through once, none is gathered.
    """
    hour = _hour()
    seen = running(updates, ["job_id"], hour, _in_order(), before=Running("max", F.struct("us", "event_id", "stage")))
    opens = F.col("before").isNull() | (F.col("before.stage") != F.col("stage"))
    stretches = running(
        seen.withColumn("opens", opens).drop("before"), ["job_id"], hour, _in_order(),
        stretch=Running("max", F.when(F.col("opens"), F.struct("us", "event_id")), inclusive=True),
    )
    columns = ["job_id", "us", "event_id", "percent", "message", "stage", "opens"]
    ordered = stretches.repartition("job_id", "stretch").sortWithinPartitions("job_id", "stretch", "us", "event_id")

    def let_through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent_us, sent = 0, None
        for frame in frames:
            keep = []
            for row in frame.itertuples(index=False):
                now = tuple(None if pd.isna(x) else x for x in (row.percent, row.message))
                passes = row.opens or (now != sent and row.us - sent_us >= interval_us)
                if passes:
                    sent_us, sent = row.us, now
                keep.append(passes)
            yield frame.loc[keep]

    return ordered.select(*columns).mapInPandas(
        let_through, "job_id long, us long, event_id long, percent long, message string, stage string, opens boolean"
    ).drop("opens")


def high_water_mark(updates: DataFrame, value: str, key: str = "job_id") -> DataFrame:
    """Pass only values above everything before them (and above 0)."""
    marked = running(updates, [key], _hour(), _in_order(), _mark=Running("max", F.col(value)))
    return marked.where(F.col(value) > F.coalesce("_mark", F.lit(0))).drop("_mark")


def failure_rate(events: DataFrame, window: str, slide: str, threshold: float = 0.20, floor: float = 1.0) -> DataFrame:
    """Share of failures among ended jobs per sliding window, with the alert flag."""
    done, failed = F.count_if(F.col("outcome") == "completed"), F.count_if(F.col("outcome") == "failed")
    rate = failed / F.greatest(done + failed, F.lit(floor))
    return (
        events.groupBy(F.window("ts", window, slide))
        .agg(done.alias("completed"), failed.alias("failed"), rate.alias("rate"))
        .select(F.col("window.start").alias("window_start"), "completed", "failed", "rate",
                (F.col("rate") > threshold).alias("alert"))
    )


def backlog(samples: DataFrame, window: str, slide: str, above: int = 10) -> DataFrame:
    """Windows in which a queue's depth never fell to ``above`` or below."""
    return (
        samples.groupBy(F.window("ts", window, slide), "queue").agg(F.min("depth").alias("least_depth"))
        .select(F.col("window.start").alias("window_start"), "queue", "least_depth",
                (F.col("least_depth") > above).alias("alert"))
    )


def frequent(actions: DataFrame, window: str, slide: str, more_than: int = 3) -> DataFrame:
    """Windows with more than ``more_than`` actions."""
    return (
        actions.groupBy(F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("actions"))
        .select(F.col("window.start").alias("window_start"), "actions", (F.col("actions") > more_than).alias("alert"))
    )
