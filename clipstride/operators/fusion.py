"""Rank fusion of several score axes, and the axes taken from chat and audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipstride.operators.joins import points_within
from clipstride.operators.scan import counts_before, ordinal
from clipstride.operators.store import written

# Fixed values.
FULL_VOTE_MESSAGES = 500
HALF_WINDOW_SEC = 30.0
SILENCE_FLOOR_DB = -99.0
WEIGHTS = {"text": 1.0, "audio": 1.0, "chat": 1.0}


def chat_weight(messages: Column, full_vote: int = FULL_VOTE_MESSAGES) -> Column:
    if full_vote <= 0:
        return F.lit(1.0)
    return F.least(F.lit(1.0), F.greatest(messages, F.lit(0)) / F.lit(float(full_vote)))


def chat_density(centres: DataFrame, chat: DataFrame, half: float = HALF_WINDOW_SEC) -> DataFrame:
    """Add ``messages``: chat lines in ``[centre - half, centre + half]``."""
    found = points_within(
        centres, chat, ["job_id"], "centre_sec", "offset_sec", half, messages=F.lit(1).cast("long")
    )
    return found.withColumn("messages", F.coalesce("messages", F.lit(0).cast("long")))


def mean_loudness(
    centres: DataFrame, loudness: DataFrame, half: float = HALF_WINDOW_SEC, floor_db: float = SILENCE_FLOOR_DB
) -> DataFrame:
    """Add ``mean_db`` over the audible samples around each centre; the floor if none.

    Levels are summed as decimals: differences of running sums stay exact.
    """
    audible = loudness.where(F.col("rms_db") > floor_db)
    found = points_within(
        centres, audible, ["job_id"], "centre_sec", "time_sec", half,
        _db=F.col("rms_db").cast("decimal(18,6)"), _n=F.lit(1).cast("long"),
    )
    mean = F.when(F.col("_n") > 0, F.round(F.col("_db").cast("double") / F.col("_n"), 6)).otherwise(F.lit(floor_db))
    return found.withColumn("mean_db", mean).drop("_db", "_n")


def tie_ranks(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Add ``rank``, best first; equal scores share the mean of their places.  Rows without a score are left out."""
    places = counts_before(scores, keys, score, descending=True).select(
        *keys, score, (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank")
    )
    return scores.join(places, [*keys, score])


def unequal_axes(scores: DataFrame) -> DataFrame:
    """Jobs whose axes do not score the same number of candidates."""
    return (
        scores.groupBy("job_id", "axis").agg(F.count("score").alias("n"))
        .groupBy("job_id").agg(F.min("n").alias("fewest"), F.max("n").alias("most"))
        .where("fewest <> most")
    )


def fuse(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Order every job's candidates by the weighted sum of their ranks.

    ``scores(job_id, candidate_id, axis, score)``, one row per axis present;
    ``weights(job_id, axis, weight)``, absent means 0.  A null score is no score on
    its axis; no candidate that has one is dropped.
    """
    ranked = tie_ranks(scores, ["job_id", "axis"])
    weighted = ranked.join(weights.select("job_id", "axis", "weight"), ["job_id", "axis"], "left")
    fused = written(weighted.groupBy("job_id", "candidate_id").agg(
        F.round(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("rank")), 6).alias("fused")
    ))
    ahead = counts_before(fused, ["job_id"], "fused").select("job_id", "fused", "before")
    tied = ordinal(
        fused, ["job_id", "fused"], F.floor(F.col("candidate_id") / 4096).cast("long"),
        [F.col("candidate_id")], "tie",
    )
    return tied.join(ahead, ["job_id", "fused"]).select(
        "job_id", "candidate_id", "fused", (F.col("before") + F.col("tie") + 1).alias("place")
    )


def fuse_checked(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """``fuse`` that refuses empty input and axes of unequal length, at the cost of a job."""
    if scores.isEmpty():
        raise ValueError("fusion needs at least one axis")
    if not unequal_axes(scores).isEmpty():
        raise ValueError("all axes of a job must score the same candidates")
    return fuse(scores, weights)


def fuse_with(candidates: DataFrame, scorers: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """Fuse axes given as expressions over one candidate table."""
    axes = F.explode(
        F.array(*[F.struct(F.lit(n).alias("axis"), c.cast("double").alias("score")) for n, c in scorers.items()])
    )
    scores = candidates.select("job_id", "candidate_id", axes.alias("x")).select("job_id", "candidate_id", "x.*")
    table = F.explode(
        F.array(*[F.struct(F.lit(n).alias("axis"), F.lit(float(w)).alias("weight")) for n, w in weights.items()])
    )
    per_job = candidates.select("job_id").distinct().select("job_id", table.alias("x")).select("job_id", "x.*")
    return fuse(scores, per_job)
