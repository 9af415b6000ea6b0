"""Detected intervals against labelled ones.

Whether a label's centre lies in any candidate is read from one sorted pass: the
furthest end among candidates that start before the centre.  Labels and candidates
are never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipstride.functions import text as tx
from clipstride.functions.intervals import centre
from clipstride.operators.joins import interval_join
from clipstride.operators.scan import Running, by_value, running, time_bucket

BUCKET_SEC = 600.0


def _middle() -> Column:
    return centre(F.col("start_sec"), F.col("end_sec"))


def _pass(queries: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """For each query the greatest mark at or before its position, as ``seen``."""
    rows = queries.withColumn("_tie", F.lit(1)).unionByName(
        marks.withColumn("_tie", F.lit(0)), allowMissingColumns=True
    )
    order = [F.col("_pos"), F.col("_tie")]
    return (
        running(rows, keys, time_bucket(F.col("_pos"), BUCKET_SEC), order, seen=Running("max", F.col("_mark")))
        .where("_tie = 1").drop("_tie", "_pos", "_mark")
    )


def label_hits(
    labels: DataFrame, candidates: DataFrame, tolerance_sec: float = 0.0, keys: list[str] | None = None
) -> DataFrame:
    """Labels with ``hit``: is the centre within any candidate, give or take?"""
    keys = keys or ["source"]
    marks = candidates.select(
        *keys, (F.col("start_sec") - tolerance_sec).alias("_pos"), (F.col("end_sec") + tolerance_sec).alias("_mark")
    )
    queries = labels.withColumn("_pos", _middle()).withColumn("_mark", F.lit(None).cast("double"))
    found = _pass(queries, marks, keys)
    return found.withColumn("hit", F.coalesce(F.col("seen") >= _middle(), F.lit(False))).drop("seen")


def false_positives(
    candidates: DataFrame, labels: DataFrame, tolerance_sec: float = 0.0, keys: list[str] | None = None
) -> DataFrame:
    """Candidates with ``false_positive``: does no label's centre lie within?"""
    keys = keys or ["source"]
    marks = labels.select(*keys, _middle().alias("_pos"), _middle().alias("_mark"))
    queries = candidates.withColumn("_pos", F.col("end_sec") + tolerance_sec).withColumn(
        "_mark", F.lit(None).cast("double")
    )
    found = _pass(queries, marks, keys)
    inside = F.col("seen") >= F.col("start_sec") - tolerance_sec
    return found.withColumn("false_positive", ~F.coalesce(inside, F.lit(False))).drop("seen")


def metrics(
    labels: DataFrame, candidates: DataFrame, tolerance_sec: float = 0.0, keys: list[str] | None = None
) -> DataFrame:
    """Hit rate, hits, misses and false positives per key; one-sided keys give zeros."""
    keys = keys or ["source"]
    slim_l = labels.select(*keys, "start_sec", "end_sec")
    slim_c = candidates.select(*keys, "start_sec", "end_sec")
    rows = label_hits(slim_l, slim_c, tolerance_sec, keys).select(*keys, "hit").unionByName(
        false_positives(slim_c, slim_l, tolerance_sec, keys).select(*keys, "false_positive"),
        allowMissingColumns=True,
    )
    totals = rows.groupBy(*keys).agg(
        F.count_if("hit").alias("hits"), F.count("hit").alias("total_labels"),
        F.count_if("false_positive").alias("false_positives"), F.count("false_positive").alias("total_candidates"),
    )
    return totals.select(
        *keys,
        F.when(F.col("total_labels") > 0, F.col("hits") / F.col("total_labels")).otherwise(F.lit(0.0)).alias("hit_rate"),
        "hits", (F.col("total_labels") - F.col("hits")).alias("misses"), "false_positives", "total_labels",
        "total_candidates",
    )


def compare_detectors(
    labels: DataFrame, candidates: DataFrame, detectors: list[str], tolerance_sec: float = 0.0
) -> DataFrame:
    """The same labels against each detector's candidates (column ``detector``)."""
    names = F.explode(F.array(*map(F.lit, detectors))).alias("detector")
    return metrics(labels.select("*", names), candidates, tolerance_sec, ["detector", "source"])


def auc(scored: DataFrame, score: str, is_true: str, keys: list[str] | None = None) -> DataFrame:
    """Chance that a true row outscores another one (ties count half); null if a class is empty.

    Rows collapse to distinct scores before anything is ordered; rows without a score take no part.
    Without ``keys`` the whole table is one set.
    """
    scope = keys or []
    counts = scored.where(F.col(score).isNotNull()).groupBy(*scope, score).agg(
        F.count_if(F.col(is_true)).alias("p"), F.count_if(~F.col(is_true)).alias("n")
    )
    below = running(
        by_value(counts, scope, score), scope, F.col("_slot"), [F.col(score)], below=Running("sum", F.col("n"))
    )
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / F.lit(2.0)))
    return below.groupBy(*scope).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"),
        F.round(wins / F.nullif(F.sum("p") * F.sum("n"), F.lit(0)), 9).alias("auc"),
    )


def score_summary(scored: DataFrame, score: str, is_true: str, keys: list[str]) -> DataFrame:
    """Counts, and the upper median and maximum of the scores of each class.

    The median is the value whose place range covers ``n div 2``, from counts per
    distinct score; no list of scores is gathered.
    """
    counts = scored.where(F.col(score).isNotNull()).groupBy(*keys, is_true, score).agg(F.count(F.lit(1)).alias("n"))
    scope = [*keys, is_true]
    placed = running(
        by_value(counts, scope, score), scope, F.col("_slot"), [F.col(score)], before=Running("sum", F.col("n"))
    )
    size = counts.groupBy(*scope).agg(F.sum("n").alias("size"), F.max(score).alias("highest"))
    half = F.floor(F.col("size") / 2)
    middle = F.when((F.col("before") <= half) & (half < F.col("before") + F.col("n")), F.col(score))
    per_class = placed.join(size, scope).groupBy(*scope).agg(
        F.max("size").alias("size"), F.max(middle).alias("median"), F.max("highest").alias("highest")
    )
    unread = scored.groupBy(*keys).agg(F.count_if(F.col(score).isNull()).alias("unparseable"))

    def of(flag: bool, column: str, name: str) -> Column:
        return F.max(F.when(F.col(is_true) == flag, F.col(column))).alias(name)

    wide = per_class.groupBy(*keys).agg(
        of(True, "size", "n_true"), of(True, "median", "median_true"), of(True, "highest", "max_true"),
        of(False, "size", "n_other"), of(False, "median", "median_other"), of(False, "highest", "max_other"),
    )
    zero = F.lit(0).cast("long")
    return unread.join(wide, keys, "left").withColumns(
        {"n_true": F.coalesce("n_true", zero), "n_other": F.coalesce("n_other", zero)}
    )


def context_text(centres: DataFrame, segments: DataFrame, half: float = 60.0) -> DataFrame:
    """What is said within ``half`` seconds of each centre ``(job_id, span_id, centre_sec)``."""
    around = centres.select(
        "job_id", "span_id", (F.col("centre_sec") - half).alias("lo"), (F.col("centre_sec") + half).alias("hi")
    )
    said = segments.where(F.trim("text") != "").select("job_id", "segment_id", "start_sec", "end_sec", "text")
    placed = interval_join(said, around, ["job_id"], ("start_sec", "end_sec"), ("lo", "hi"), width=half, closed=True)
    texts = placed.groupBy("job_id", "span_id").agg(
        tx.collapse(
            F.transform(
                F.array_sort(F.collect_list(F.struct("start_sec", "segment_id", F.trim("text").alias("said")))),
                lambda x: x["said"],
            )
        ).alias("context")
    )
    return centres.join(texts, ["job_id", "span_id"], "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )
