"""Composite window scores and the selection of clip candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipstride.functions.intervals import centre, overlap_ratio
from clipstride.operators.greedy import keep_disjoint, keep_spaced
from clipstride.operators.store import written
from clipstride.operators.snap import HOOK_LEAD_IN_SEC, MIN_CLIP_SEC, shift_to_peak
from clipstride.operators.windows import (
    Heard,
    WindowParams,
    durations,
    excerpts,
    heard,
    span_metrics,
    tasks_of,
    window_metrics,
)

# Score weights with and without loudness samples.
WEIGHTS = {"loudness": 0.45, "emotion": 0.20, "continuity": 0.20, "silence": 0.15}
WEIGHTS_WITHOUT_LOUDNESS = {"density": 0.35, "silence": 0.25, "emotion": 0.20, "continuity": 0.20}

# What passes to review.
MIN_EXCERPT_CHARS = 3
MIN_SCORE = 0.5
NMS_WINDOW_SEC = 45.0


def normalisers(metrics: DataFrame) -> DataFrame:
    """Per recording: the extremes that scores are measured against."""
    return metrics.groupBy("job_id").agg(
        F.max("speech_density").alias("max_density"),
        F.max("emotion_hits").alias("max_hits"),
        F.min("peak_db").alias("min_db"),
        (F.max("peak_db") - F.min("peak_db")).alias("range_db"),
        (F.count("peak_db") > 0).alias("has_loudness"),
    )


def with_score(metrics: DataFrame, norms: DataFrame) -> DataFrame:
    """Add ``loudness`` (0..1) and ``total_score``.

    Windows pass by a table of their recordings' extremes, so a task sorts none of them.
    """

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    loud = F.when(
        F.col("has_loudness") & F.col("peak_db").isNotNull(),
        F.when(F.col("range_db") > 0, (F.col("peak_db") - F.col("min_db")) / F.col("range_db")).otherwise(1.0),
    ).otherwise(F.lit(0.0))
    hits = ratio("emotion_hits", "max_hits")
    density = ratio("speech_density", "max_density")
    speaking = F.lit(1.0) - F.col("silence_ratio")
    w, v = WEIGHTS, WEIGHTS_WITHOUT_LOUDNESS
    total = F.when(
        F.col("has_loudness"),
        w["loudness"] * loud + w["emotion"] * hits + w["continuity"] * F.col("continuity_score")
        + w["silence"] * speaking,
    ).otherwise(
        v["density"] * density + v["silence"] * speaking + v["emotion"] * hits
        + v["continuity"] * F.col("continuity_score")
    )
    return (
        metrics.join(norms.hint("shuffle_hash"), "job_id")
        .withColumn("loudness", F.round(loud, 6))
        .withColumn("total_score", F.round(total, 6))
        .drop("max_density", "max_hits", "min_db", "range_db", "has_loudness")
    )


def select_non_overlapping(
    scored: DataFrame,
    p: WindowParams = WindowParams(),
    *,
    top_n: int | None = None,
    min_overlap_ratio: float = 0.0,
) -> DataFrame:
    """Best windows first; drop a window overlapping a kept one by more than the ratio."""
    if top_n is not None and top_n <= 0:
        return scored.limit(0)
    priority = [(-F.col("total_score")).alias("rank"), F.col("w_start"), F.col("w_end")]
    if min_overlap_ratio >= 1.0:
        kept = scored
    elif min_overlap_ratio > 0.0:
        kept = keep_disjoint(
            scored, ["job_id"], "w_start", "w_end", priority,
            lambda k, x: overlap_ratio(k["s"], k["e"], x["s"], x["e"]) > min_overlap_ratio,
            tasks=tasks_of(scored, scored.count()),
        )
    else:
        kept = keep_spaced(
            scored, ["job_id"], "w_start", priority, p.window_sec, strict=True, tasks=tasks_of(scored, scored.count())
        )
    if top_n is None:
        return kept
    order = Window.partitionBy("job_id").orderBy(F.desc("total_score"), "w_start", "w_end")
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top_n).drop("_n")


@dataclass(frozen=True)
class DetectorParams:
    windows: WindowParams = WindowParams()
    top_n: int | None = None
    min_overlap_ratio: float = 0.0
    lead_in_sec: float = HOOK_LEAD_IN_SEC
    min_clip_sec: float = MIN_CLIP_SEC


def scored_windows(
    segments: DataFrame,
    silence: DataFrame,
    loudness: DataFrame | None,
    p: WindowParams = WindowParams(),
    lengths: DataFrame | None = None,
) -> DataFrame:
    metrics = written(window_metrics(segments, silence, loudness, p, lengths))
    return with_score(metrics, normalisers(metrics))


def clip_candidates(
    segments: DataFrame,
    silence: DataFrame,
    loudness: DataFrame | None,
    p: DetectorParams = DetectorParams(),
    lengths: DataFrame | None = None,
) -> DataFrame:
    """The heuristic detector: windows, scores, selection, hook shift, final scores."""
    w = p.windows
    lengths = durations(segments, silence) if lengths is None else lengths
    # windows and clips are measured by the same words, whose hits are counted once
    found = Heard(*[part if part is None else written(part) for part in heard(segments, silence, w.keywords)])
    metrics = written(window_metrics(segments, silence, loudness, w, lengths, found))
    norms = normalisers(metrics)
    chosen = select_non_overlapping(
        with_score(metrics, norms), w, top_n=p.top_n, min_overlap_ratio=p.min_overlap_ratio
    )
    shifted = written(shift_to_peak(chosen, segments, silence, p.lead_in_sec, p.min_clip_sec))
    return rescore(shifted, norms, segments, silence, loudness, w, found)


def rescore(
    shifted: DataFrame,
    norms: DataFrame,
    segments: DataFrame,
    silence: DataFrame,
    loudness: DataFrame | None,
    p: WindowParams = WindowParams(),
    found: Heard | None = None,
) -> DataFrame:
    """Measure each clip from its shifted start, against the recording's extremes."""
    spans = shifted.select("job_id", "window_no", F.col("clip_start").alias("w_start"), "w_end")
    again = with_score(
        span_metrics(spans, segments, silence, loudness, p.keywords, p.window_sec, found), norms
    ).select("job_id", "window_no", F.col("total_score").alias("clip_score"))
    said = excerpts(spans.withColumnRenamed("window_no", "span_id"), segments, p.window_sec)
    moved = F.col("clip_start") > F.col("w_start")
    return (
        shifted.select("job_id", "window_no", "w_start", "w_end", "clip_start", "total_score")
        .join(again, ["job_id", "window_no"], "left")
        .join(said.withColumnRenamed("span_id", "window_no"), ["job_id", "window_no"], "left")
        .select(
            "job_id",
            F.col("clip_start").alias("start_sec"),
            F.col("w_end").alias("end_sec"),
            F.when(moved, F.col("clip_score")).otherwise(F.col("total_score")).alias("score"),
            F.coalesce("excerpt", F.lit("")).alias("excerpt"),
        )
    )


def temporal_nms(
    candidates: DataFrame, window_sec: float = NMS_WINDOW_SEC, keys: tuple[str, ...] = ("job_id",)
) -> DataFrame:
    """Keep the best of any candidates whose centres lie within ``window_sec``."""
    if window_sec <= 0:
        return candidates
    extra = [c for c in candidates.columns if c not in (*keys, "start_sec", "end_sec", "score", "_centre")]
    priority = [(-F.col("score")).alias("rank"), F.col("start_sec"), F.col("end_sec"), *map(F.col, sorted(extra))]
    placed = candidates.withColumn("_centre", centre(F.col("start_sec"), F.col("end_sec")))
    return keep_spaced(placed, keys, "_centre", priority, window_sec, strict=False).drop("_centre")


def candidate_gate(
    candidates: DataFrame,
    *,
    min_excerpt_chars: int = MIN_EXCERPT_CHARS,
    min_score: float = MIN_SCORE,
    nms_window_sec: float = NMS_WINDOW_SEC,
    top_n: int | None = None,
) -> DataFrame:
    """Drop wordless or weak candidates, thin them in time; keep the first ``top_n`` if given."""
    passing = candidates.where(
        (F.length(F.trim("excerpt")) >= min_excerpt_chars) & (F.col("score") >= min_score)
    )
    thinned = temporal_nms(passing, nms_window_sec)
    if top_n is None:
        return thinned
    order = Window.partitionBy("job_id").orderBy(F.desc("score"), "start_sec", "end_sec")
    return thinned.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top_n).drop("_n")
