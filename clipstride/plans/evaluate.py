"""Frozen inputs replayed through the detectors and scored against labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.operators import evaluation as ev
from clipstride.operators import scoring
from clipstride.operators.store import written
from clipstride.operators.windows import WindowParams, durations
from clipstride.plans.detect import detect_routed
from clipstride.sources.results import Request

SETTINGS = ("window_duration_sec", "step_sec", "top_n", "min_overlap_ratio", "emotion_keywords")


def detect_request(request: Request) -> DataFrame:
    """Heuristic candidates of a replayed input, each recording under its own settings.

    Recordings that share settings form one plan; what is collected is the list of
    distinct settings, not data.
    """
    params = request.params
    settings = params.select(*SETTINGS).distinct().collect()

    def under(row) -> DataFrame:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(_literal(row[c])) for c in SETTINGS])
        jobs = params.where(same).select("job_id", "duration_sec")
        parts = [
            df.join(jobs.select("job_id"), "job_id", "left_semi")
            for df in (request.segments, request.silence, request.loudness)
        ]
        p = scoring.DetectorParams(
            WindowParams(row.window_duration_sec, row.step_sec, tuple(row.emotion_keywords or ())),
            top_n=row.top_n, min_overlap_ratio=row.min_overlap_ratio,
        )
        return scoring.clip_candidates(*parts, p, durations(parts[0], parts[1], jobs))

    return reduce(DataFrame.unionByName, [under(row) for row in settings])


def _literal(value):
    if isinstance(value, list):
        return F.array(*map(F.lit, value)) if value else F.from_json(F.lit("[]"), "array<string>")
    return F.lit(value)


def compare_on(
    request: Request, labels: DataFrame, answers: DataFrame, keywords: tuple[str, ...], tolerance_sec: float = 0.0
) -> DataFrame:
    """Both detectors on the same frozen input, against ``labels(source, start_sec, end_sec)``.

    A label's source is the recording's id.
    """
    heuristic = written(detect_request(request)).withColumn("detector", F.lit("heuristic"))
    hybrid = detect_routed(request.segments, request.silence, request.loudness, answers, keywords)
    found = heuristic.unionByName(hybrid.drop("path").withColumn("detector", F.lit("hybrid")))
    named = written(found.select("detector", F.col("job_id").alias("source"), "start_sec", "end_sec"))
    return ev.compare_detectors(labels, named, ["heuristic", "hybrid"], tolerance_sec)
