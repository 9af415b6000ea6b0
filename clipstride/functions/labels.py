"""How durations, times and caption text are written out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(column: Column) -> Column:
    return column.cast("long")


def duration_label(seconds: Column) -> Column:
    """``45s`` or ``2m 5s``."""
    m, s = _int(F.floor(seconds / 60)), _int(F.floor(F.pmod(seconds, F.lit(60))))
    return (
        F.when(seconds.isNull(), "n/a").when(m == 0, F.format_string("%ds", s))
        .otherwise(F.format_string("%dm %ds", m, s))
    )


def elapsed_label(from_us: Column, to_us: Column) -> Column:
    """Whole seconds between two times: ``40s``, ``5m``, ``5m 3s`` or ``2h 10m``."""
    gap = F.floor((to_us - from_us) / F.lit(1_000_000)).cast("long")
    total = F.when(gap < 0, F.lit(0).cast("long")).otherwise(gap)
    h, m, s = _int(F.floor(total / 3600)), _int(F.floor(total % 3600 / 60)), total % 60
    return (
        F.when(total.isNull(), "n/a").when(total < 60, F.format_string("%ds", total))
        .when(h > 0, F.format_string("%dh %dm", h, m))
        .when((m > 0) & (s > 0), F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%dm", m))
    )


def clip_stamp(seconds: Column) -> Column:
    """``MM:SS.t``, or ``HH:MM:SS.t`` from an hour on; tenths are cut, not rounded."""
    total = F.greatest(seconds, F.lit(0.0))
    h, m = _int(F.floor(total / 3600)), _int(F.floor(F.pmod(total, F.lit(3600.0)) / 60))
    rest = F.pmod(total, F.lit(60.0))
    s = _int(F.floor(rest))
    tenth = _int(F.floor((rest - F.floor(rest)) * 10))
    return (
        F.when(seconds.isNull(), "n/a")
        .when(h > 0, F.format_string("%02d:%02d:%02d.%d", h, m, s, tenth))
        .otherwise(F.format_string("%02d:%02d.%d", m, s, tenth))
    )


def caption_time(seconds: Column) -> Column:
    """``H:MM:SS.cc``, rounded to centiseconds before it is split."""
    cs = F.round(seconds * 100).cast("long")
    return F.format_string(
        "%d:%02d:%02d.%02d", _int(F.floor(cs / 360000)), _int(F.floor(cs / 6000)) % 60,
        _int(F.floor(cs / 100)) % 60, cs % 100,
    )


def karaoke(words: Column) -> Column:
    """Words with their highlight lengths in centiseconds, at least 1."""

    def token(w: Column) -> Column:
        cs = F.greatest(F.lit(1).cast("long"), F.ceil((w["end_sec"] - w["start_sec"]) * 100).cast("long"))
        return F.concat(F.lit("{\\kf"), cs.cast("string"), F.lit("}"), w["word"])

    return F.array_join(F.transform(words, token), " ")
