"""Silence and loudness read from media tool logs, as tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.operators.scan import Running, ordinal, running

# What the lines look like, and the level written for digital silence.
SILENCE_START = r"silence_start:\s*(\d+(?:\.\d+)?)"
SILENCE_END = r"silence_end:\s*(\d+(?:\.\d+)?)\s*\|\s*silence_duration:\s*(\d+(?:\.\d+)?)"
RMS_LEVEL = r"lavfi\.astats\.Overall\.RMS_level=(-?\d+(?:\.\d+)?|-inf)"
DIGITAL_SILENCE_DB = -100.0
MIN_INTERVAL_SEC = 0.1
LINES_PER_BUCKET = 100_000


def _bucket():
    return F.floor(F.col("line_no") / LINES_PER_BUCKET).cast("long")


def silence_from_log(lines: DataFrame) -> DataFrame:
    """Each end line with the start line just before it among the lines that matter.

    A later start replaces an unmatched one; an end without a start is dropped.
    """
    started = F.nullif(F.regexp_extract("line", SILENCE_START, 1), F.lit("")).cast("double")
    ended = F.nullif(F.regexp_extract("line", SILENCE_END, 1), F.lit("")).cast("double")
    lasted = F.nullif(F.regexp_extract("line", SILENCE_END, 2), F.lit("")).cast("double")
    marks = (
        lines.select("log_id", "line_no", started.alias("start_sec"), ended.alias("end_sec"), lasted.alias("duration_sec"))
        .where("start_sec is not null or end_sec is not null")
    )
    linked = running(
        marks.withColumnRenamed("start_sec", "opens"), ["log_id"], _bucket(), [F.col("line_no")],
        before=Running("max", F.struct("line_no", F.col("opens").alias("start_sec"))),
    )
    return linked.where("opens is null and before.start_sec is not null").select(
        "log_id", F.col("before.start_sec").alias("start_sec"), "end_sec", "duration_sec"
    )


def loudness_from_log(lines: DataFrame, interval_sec: float = 1.0) -> DataFrame:
    """Level lines in order, one per interval."""
    step = max(MIN_INTERVAL_SEC, interval_sec)
    level = F.regexp_extract("line", RMS_LEVEL, 1)
    levels = lines.select("log_id", "line_no", level.alias("level")).where("level <> ''")
    return ordinal(levels, ["log_id"], _bucket(), [F.col("line_no")], "n").select(
        "log_id", (F.col("n") * F.lit(step)).alias("time_sec"),
        F.when(F.col("level") == "-inf", DIGITAL_SILENCE_DB).otherwise(F.expr("try_cast(level as double)"))
        .alias("rms_db"),
    )
