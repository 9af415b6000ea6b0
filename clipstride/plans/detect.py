"""Whole detection runs: which detector handles which recording."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.operators import moments as mo
from clipstride.operators import scoring, windows
from clipstride.operators.store import written


def detect(
    segments: DataFrame, silence: DataFrame, loudness: DataFrame | None, p: scoring.DetectorParams
) -> DataFrame:
    """The heuristic detector followed by the candidate gate."""
    return scoring.candidate_gate(scoring.clip_candidates(segments, silence, loudness, p))


def ask(
    segments: DataFrame, silence: DataFrame, loudness: DataFrame | None, keywords: Sequence[str],
    generate: Callable[[list[str]], list[str]],
) -> DataFrame:
    """Prompt a user's model for every chunk; written once, because a model is dear."""
    lengths = windows.durations(segments, silence)
    asked = mo.prompts(segments, silence, loudness, lengths, keywords)
    return written(mo.answer(asked, generate)).select(
        "job_id", F.col("chunk_no").alias("response_no"), "raw", F.col("raw").isNull().alias("failed")
    )


def detect_routed(
    segments: DataFrame, silence: DataFrame, loudness: DataFrame | None, answers: DataFrame,
    keywords: Sequence[str] = (), top_n: int | None = None, *, settings: scoring.DetectorParams | None = None, gated: bool = False,
) -> DataFrame:
    """Candidates from ``answers(job_id, response_no, raw, failed)`` where they are usable.

    Recordings without an answer, or with a failed one, get the heuristic detector, under ``settings`` if given (their
    ``top_n`` then holds on both paths). ``gated`` passes the candidates of either path through the candidate gate.
    """
    settings = settings or scoring.DetectorParams(windows.WindowParams(keywords=keywords), top_n=top_n)
    state = answers.groupBy("job_id").agg(F.max("failed").alias("failed"))
    usable = state.where(~F.col("failed")).select("job_id")
    parsed = mo.parse_highlights(answers.join(usable, "job_id", "left_semi").drop("failed"))
    numbered = parsed.withColumn("moment_id", F.struct("response_no", "pos"))
    merged = written(mo.merge_moments(numbered, ["response_no", "pos"]))
    from_answers = mo.moments_to_candidates(merged, segments, settings.top_n).drop("moment_id")
    rest = [df if df is None else written(df.join(usable, "job_id", "left_anti")) for df in (segments, silence, loudness)]
    heuristic = scoring.clip_candidates(*rest, settings)
    found = from_answers.withColumn("path", F.lit("answers")).unionByName(heuristic.withColumn("path", F.lit("heuristic")))
    return scoring.candidate_gate(written(found)) if gated else found
