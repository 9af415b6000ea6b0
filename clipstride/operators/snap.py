"""Move a clip's start close to its loudest moment, onto a natural boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.operators.scan import time_bucket
from clipstride.operators.windows import word_rows, wordless_segments

# Fixed values.
HOOK_LEAD_IN_SEC = 0.4
MIN_CLIP_SEC = 8.0
SNAP_RADIUS_SEC = 0.6


def boundaries(segments: DataFrame, silence: DataFrame) -> DataFrame:
    """Every edge a clip may start on, with the interval it belongs to.

    Word edges carry the bounds of their segment.  ``place`` is the order in which
    equally near edges are preferred: transcript before silence, each in time order.
    """

    def edges(df: DataFrame, lo: str, hi: str, source: int, segment: str, pos: str) -> DataFrame:
        both = F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("start_sec").alias("edge_sec")),
                F.struct(F.lit(1).alias("side"), F.col("end_sec").alias("edge_sec")),
            )
        )
        return df.select("job_id", F.col(lo).alias("lo"), F.col(hi).alias("hi"),
                         F.expr(segment).cast("long").alias("seg"), F.expr(pos).cast("long").alias("pos"),
                         both.alias("b")).select(
            "job_id", "lo", "hi", F.col("b.edge_sec").alias("edge_sec"),
            F.struct(F.lit(source).alias("source"), F.col("lo").alias("from"), F.col("seg").alias("seg"),
                     F.col("pos").alias("pos"), F.col("b.side").alias("side")).alias("place"),
        )

    return (
        edges(word_rows(segments), "seg_start", "seg_end", 0, "segment_id", "pos")
        .unionByName(edges(wordless_segments(segments), "start_sec", "end_sec", 0, "segment_id", "-1"))
        .unionByName(edges(silence, "start_sec", "end_sec", 1, "0", "0"))
    )


def nearest_boundary(
    targets: DataFrame,
    segments: DataFrame,
    silence: DataFrame,
    target: str = "target_sec",
    radius: float = SNAP_RADIUS_SEC,
) -> DataFrame:
    """Add ``snapped_sec``: the nearest edge to each target, or the target itself.

    An interval qualifies when it comes within ``radius`` of the target; of its edges
    any one less than ``radius + 1`` away may be taken.  Edges and targets meet in
    buckets no wider than that distance.
    """
    far = radius + 1.0
    width = 2.0 * far
    t = F.col(target)
    spots = targets.where(t.isNotNull()).select("job_id", target).distinct().withColumn(
        "_bucket", F.explode(F.sequence(time_bucket(t - far, width), time_bucket(t + far, width)))
    )
    edges = boundaries(segments, silence).withColumn("_bucket", time_bucket(F.col("edge_sec"), width))
    away = F.abs(F.col("edge_sec") - t)
    near = (
        spots.join(edges, ["job_id", "_bucket"])
        .where((F.col("hi") >= t - radius) & (F.col("lo") <= t + radius) & (away < far))
        .groupBy("job_id", target)
        .agg(F.min(F.struct(away.alias("away"), "place", "edge_sec")).alias("best"))
        .select("job_id", target, F.col("best.edge_sec").alias("_edge"))
    )
    return (
        targets.join(near, ["job_id", target], "left")
        .withColumn("snapped_sec", F.coalesce("_edge", t))
        .drop("_edge")
    )


def shift_to_peak(
    windows: DataFrame,
    segments: DataFrame,
    silence: DataFrame,
    lead_in_sec: float = HOOK_LEAD_IN_SEC,
    min_clip_sec: float = MIN_CLIP_SEC,
) -> DataFrame:
    """Add ``clip_start``; windows without a loudness sample keep their start."""
    start, end, peak = F.col("w_start"), F.col("w_end"), F.col("peak_time_sec")
    aimed = windows.withColumn(
        "_target", F.when(peak.isNotNull(), F.least(F.greatest(peak - lead_in_sec, start, F.lit(0.0)), peak))
    )
    snapped = nearest_boundary(aimed, segments, silence, "_target")
    within = F.least(F.greatest(F.col("snapped_sec"), start, F.lit(0.0)), peak)
    long_enough = F.least(within, F.greatest(start, end - min_clip_sec))
    clip_start = F.when(peak.isNull(), start).otherwise(F.round(long_enough, 6))
    return snapped.withColumn("clip_start", clip_start).drop("_target", "snapped_sec")
