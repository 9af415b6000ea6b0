"""Sliding windows over every recording, and what is heard inside a span of time.

A *span* is any interval to be measured: a window of the regular grid or a clip.
Speech, silence and loudness samples are brought to the spans they fall in and added
up by one grouped aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipstride.functions import text as tx
from clipstride.functions.intervals import overlap
from clipstride.operators.joins import interval_join

# Fixed value: pauses up to this long do not interrupt speech.
WORD_GAP_SEC = 0.6
# Windows are worked on in blocks of this length, so a long recording is many tasks.
BLOCK_SEC = 600.0
# Words (or loudness samples, or windows) of one task, about: more of them make more tasks, not larger ones.
TASK_WORDS = 100_000


@dataclass(frozen=True)
class WindowParams:
    window_sec: float = 30.0
    step_sec: float = 5.0
    keywords: Sequence[str] = field(default_factory=tuple)

    @property
    def step(self) -> float:
        return max(0.1, self.step_sec)


def durations(segments: DataFrame, silence: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Length of each recording: as given (not below 0), else the last end seen."""
    ends = segments.select("job_id", "end_sec").unionByName(silence.select("job_id", "end_sec"))
    if given is None:
        return ends.groupBy("job_id").agg(F.greatest(F.lit(0.0), F.max("end_sec")).alias("duration_sec"))
    rows = ends.withColumn("given", F.lit(None).cast("double")).unionByName(
        given.select(
            "job_id", F.lit(0.0).alias("end_sec"), F.col("duration_sec").cast("double").alias("given")
        )
    )
    return rows.groupBy("job_id").agg(
        F.when(F.max("given").isNotNull(), F.greatest(F.lit(0.0), F.max("given")))
        .otherwise(F.coalesce(F.max("end_sec"), F.lit(0.0))).alias("duration_sec")
    )


def grid(lengths: DataFrame, p: WindowParams) -> DataFrame:
    """Add, where there are windows, how many there are and where the last one starts."""
    last = F.greatest(F.lit(0.0), F.col("duration_sec") - p.window_sec)
    return (
        lengths.where("duration_sec > 0")
        .withColumn("last_start", last)
        .withColumn("n_windows", F.ceil(F.col("last_start") / p.step).cast("long") + 1)
    )


def _bounds(df: DataFrame, p: WindowParams) -> DataFrame:
    start = F.least(F.col("window_no") * F.lit(float(p.step)), F.col("last_start"))
    return df.withColumn("w_start", start).withColumn(
        "w_end",
        F.when(F.col("duration_sec") <= p.window_sec, F.col("duration_sec")).otherwise(
            start + p.window_sec
        ),
    )


def sliding_windows(lengths: DataFrame, p: WindowParams) -> DataFrame:
    every = grid(lengths, p).withColumn(
        "window_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_windows") - 1))
    )
    return _bounds(every, p).select("job_id", "window_no", "w_start", "w_end")


def tasks_for(segments: DataFrame) -> int:
    """How many tasks the words of ``segments`` are dealt to."""
    words = segments.agg(F.sum(F.greatest(F.lit(1), F.size("words")))).first()[0] or 0
    return tasks_of(segments, words)


def tasks_of(df: DataFrame, rows: int) -> int:
    """How many tasks so many rows are dealt to.

    A task that deals rows to more tasks than ``spark.shuffle.sort.bypassMergeThreshold`` keeps them in memory, and
    that grows with what it reads: beyond that number tasks become up to eight times as large before there are more.
    """
    conf = df.sparkSession.conf
    usual, direct = int(conf.get("spark.sql.shuffle.partitions")), int(conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(usual, min(direct, math.ceil(rows / TASK_WORDS)), math.ceil(rows / (8 * TASK_WORDS)))


def place_on_grid(items: DataFrame, lengths: DataFrame, p: WindowParams, tasks: int | None = None) -> DataFrame:
    """Attach each interval ``[start_sec, end_sec]`` to the blocks of windows it touches.

    Windows are cut into blocks by their start, so which blocks an interval reaches
    follows from arithmetic; about one in ``BLOCK_SEC / window`` is repeated in a
    second block.  The recording's length arrives in each of its blocks as a row of
    its own (kind ``span``) instead of by a join, so the data is shuffled once, by
    (recording, block), however long a recording is.
    """
    last_start = F.greatest(F.lit(0.0), F.col("duration_sec") - p.window_sec)
    spans = lengths.where("duration_sec > 0").select(
        "job_id", F.lit("span").alias("kind"), F.lit(0.0).alias("start_sec"), F.col("duration_sec").alias("end_sec"),
        "duration_sec", F.lit(0).cast("long").alias("_first"), F.floor(last_start / BLOCK_SEC).cast("long").alias("_last"),
    )
    reach = items.withColumns({
        "_first": F.floor(F.greatest(F.lit(0.0), F.col("start_sec") - p.window_sec) / BLOCK_SEC).cast("long"),
        "_last": F.floor(F.greatest(F.lit(0.0), F.col("end_sec")) / BLOCK_SEC).cast("long"),
    })
    placed = reach.unionByName(spans, allowMissingColumns=True).withColumn(
        "block", F.explode(F.sequence("_first", "_last"))
    ).drop("_first", "_last")
    if tasks is not None:
        placed = placed.repartition(tasks, "job_id", "block")
    known = F.max("duration_sec").over(Window.partitionBy("job_id", "block"))
    return grid(placed.withColumn("duration_sec", known), p)


def to_windows(placed: DataFrame, p: WindowParams) -> DataFrame:
    """Repeat placed intervals for every window of their block they may touch."""
    lo = F.greatest(
        F.lit(0).cast("long"),
        F.floor((F.col("start_sec") - p.window_sec) / p.step).cast("long"),
        F.floor(F.col("block") * BLOCK_SEC / p.step).cast("long"),
    )
    hi = F.least(
        F.col("n_windows") - 1,
        F.ceil(F.col("end_sec") / p.step).cast("long"),
        F.ceil((F.col("block") + 1) * BLOCK_SEC / p.step).cast("long"),
    )
    every = (
        placed.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
        .withColumn("window_no", F.explode(F.sequence("_lo", "_hi")))
    )
    return (
        _bounds(every, p)
        .where(F.floor(F.col("w_start") / BLOCK_SEC) == F.col("block"))
        .drop("_lo", "_hi", "duration_sec", "last_start", "n_windows")
    )


def word_rows(segments: DataFrame) -> DataFrame:
    """One row per timed word, with its segment's bounds and its place."""
    return segments.where(F.size("words") > 0).select(
        "job_id", "segment_id",
        F.col("start_sec").alias("seg_start"), F.col("end_sec").alias("seg_end"),
        F.posexplode("words").alias("pos", "w"),
    ).select(
        "job_id", "segment_id", "seg_start", "seg_end", "pos",
        F.col("w.word").alias("word"),
        F.col("w.start_sec").alias("start_sec"), F.col("w.end_sec").alias("end_sec"),
    )


def wordless_segments(segments: DataFrame) -> DataFrame:
    return segments.where((F.size("words") <= 0) | F.col("words").isNull())


def spoken_intervals(segments: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Words, and whole segments where there are no words, with what each contributes.

    Keywords without a space, ``!`` and capitalised words cannot reach across words,
    so their hits belong to single words and are counted once, before any window.
    """
    single = [k for k in tx.clean_keywords(keywords) if len(k.split()) == 1]
    timed = F.size("words") > 0
    nothing = F.lit(None).cast("double")
    words = F.transform(
        "words",
        lambda w: F.struct(w["word"].alias("said"), w["start_sec"].alias("s"), w["end_sec"].alias("e")),
    )
    whole = F.array(
        F.struct(F.col("text").alias("said"), F.col("start_sec").alias("s"), F.col("end_sec").alias("e"))
    )
    rows = segments.select(
        "job_id", F.col("start_sec").alias("seg_start"), F.col("end_sec").alias("seg_end"),
        F.when(timed, nothing).otherwise(F.col("word_count").cast("double")).alias("prorated"),
        F.explode(F.when(timed, words).otherwise(whole)).alias("x"),
    )
    hits = F.when(F.col("prorated").isNull(), tx.emotion_hits(F.col("x.said"), single)).otherwise(
        tx.emotion_hits(F.col("x.said"), keywords)
    )
    return rows.select(
        "job_id", F.col("x.s").alias("start_sec"), F.col("x.e").alias("end_sec"),
        "seg_start", "seg_end", "prorated", hits.alias("hits"),
    ).where("end_sec > start_sec")


_ITEM = {
    "job_id": None, "kind": "string", "start_sec": "double", "end_sec": "double", "seg_start": "double",
    "seg_end": "double", "prorated": "double", "hits": "long",
}


def _items(df: DataFrame, kind: str, **values: Column) -> DataFrame:
    def column(name: str, kind_type: str | None) -> Column:
        if name == "kind":
            return F.lit(kind).alias(name)
        if name in values:
            return values[name].alias(name)
        if name in df.columns:
            return F.col(name)
        return F.lit(None).cast(kind_type).alias(name)

    return df.select(*[column(n, t) for n, t in _ITEM.items()])


def _sources(segments: DataFrame, silence: DataFrame | None, keywords: Sequence[str]) -> DataFrame:
    rows = _items(spoken_intervals(segments, keywords), "speech")
    if silence is not None:
        rows = rows.unionByName(_items(silence, "silence"))
    return rows


def loudest_moment(loudness: DataFrame | None, place) -> DataFrame | None:
    """The loudest sample of each span and its time, the earliest of equal ones.

    Kept apart from the other numbers: comparing pairs needs a sorting aggregate,
    which the (more numerous) words should not go through.
    """
    if loudness is None:
        return None
    at = F.col("time_sec")
    samples = loudness.select("job_id", at.alias("start_sec"), at.alias("end_sec"), "rms_db")
    best = F.max(F.struct(F.col("rms_db"), (-F.col("start_sec")).alias("neg_time"))).alias("best")
    placed = place(samples).where("start_sec >= w_start and start_sec < w_end")
    return (
        placed.groupBy("job_id", "window_no", "w_start", "w_end", *_block(placed)).agg(best)
        .select(
            "job_id", "window_no", "w_start", "w_end", F.col("best.rms_db").alias("peak_db"),
            (-F.col("best.neg_time")).alias("peak_time_sec"),
        )
    )


def with_runs(items: DataFrame, within: Sequence[str], gap: float = WORD_GAP_SEC) -> DataFrame:
    """Label speech with the run of continuous speech it belongs to, inside ``within``.

    An interval outside a window never closes a gap between two that overlap it, so
    runs found in a block, cut down to a window, equal the runs of that window.
    """
    speech = F.col("kind") == "speech"
    order = Window.partitionBy(*within).orderBy("start_sec", "end_sec")
    said_until = F.max(F.when(speech, F.col("end_sec"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    reach = items.withColumn("_until", said_until)
    opens = speech & (F.col("_until").isNull() | (F.col("start_sec") > F.col("_until") + gap))
    run = F.max(F.when(opens, F.col("start_sec"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return reach.withColumn("run", F.when(speech, run)).drop("_until")


def _phrases(keywords: Sequence[str]) -> list[str]:
    return [k for k in tx.clean_keywords(keywords) if len(k.split()) > 1]


class Heard(NamedTuple):
    """What spans are measured by: speech and silence, and the segments that hold a keyword of several words (if there are such)."""

    items: DataFrame
    phrased: DataFrame | None


def heard(segments: DataFrame, silence: DataFrame | None, keywords: Sequence[str]) -> Heard:
    items = _sources(segments, silence, keywords)
    if not (phrases := _phrases(keywords)):
        return Heard(items, None)
    joined = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    return Heard(items, segments.where(F.size("words") > 0).where(tx.keyword_hits(joined, phrases) > 0))


def phrase_hits(phrased: DataFrame | None, keywords: Sequence[str], place) -> DataFrame | None:
    """Hits of keywords of several words, which need the text of each span.

    Only segments that contain such a phrase at all are looked at.
    """
    if phrased is None:
        return None
    phrases = _phrases(keywords)
    placed = place(word_rows(phrased)).where(_inside())
    said = placed.groupBy("job_id", "window_no", "w_start", "w_end", "segment_id", "seg_start", *_block(placed)).agg(
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("said")
    )
    text = F.array_join(F.transform("said", lambda w: w["word"]), " ")
    return said.select(
        "job_id", "window_no", "w_start", "w_end",
        tx.keyword_hits(text, phrases).cast("long").alias("hits"),
    )


def _block(placed: DataFrame) -> list[str]:
    """The block of windows that rows were dealt by: a window lies in one, so grouping by it too sends nothing anywhere."""
    return [c for c in ("block",) if c in placed.columns]


def _inside() -> Column:
    return (
        (F.col("start_sec") < F.col("w_end")) & (F.col("end_sec") > F.col("w_start"))
        & (F.col("seg_start") < F.col("w_end")) & (F.col("seg_end") > F.col("w_start"))
    )


def _measure(touching: DataFrame, *extra: DataFrame | None, tasks: int | None = None) -> DataFrame:
    """Add up what falls into each span, run by run where it lies, then together with what ``extra`` says of the span."""
    span = ["job_id", "window_no", "w_start", "w_end"]
    kind = F.col("kind")
    shared = overlap(F.col("start_sec"), F.col("end_sec"), F.col("w_start"), F.col("w_end"))
    said = (kind == "speech") & _inside()
    quiet = (kind == "silence") & (shared > 0)
    amount = F.coalesce(
        F.col("prorated") * (shared / (F.col("end_sec") - F.col("start_sec"))), F.lit(1.0)
    )
    dealt = [*span, *_block(touching)]
    rows = touching.where(said | quiet | (kind == "span")).select(
        *dealt, "run",
        F.when(said, amount).alias("words"),
        F.when(said, F.col("hits")).alias("hits"),
        F.when(said, F.greatest("start_sec", "w_start")).alias("said_from"),
        F.when(said, F.least("end_sec", "w_end")).alias("said_to"),
        F.when(quiet, shared).alias("quiet_sec"),
    )
    per_run = rows.groupBy(*dealt, "run").agg(
        F.sum("words").alias("words"),
        F.sum("hits").alias("hits"),
        (F.max("said_to") - F.min("said_from")).alias("run_sec"),
        F.sum("quiet_sec").alias("quiet_sec"),
    )
    per_span = per_run.groupBy(*dealt).agg(
        F.sum("words").alias("words"), F.sum("hits").alias("hits"), F.max("run_sec").alias("run_sec"),
        F.sum("quiet_sec").alias("quiet_sec"),
    ).select(
        *span, "words", "hits", "run_sec", "quiet_sec",
        F.lit(None).cast("double").alias("peak_db"), F.lit(None).cast("double").alias("peak_time_sec"),
    )
    for part in extra:
        if part is not None:
            per_span = per_span.unionByName(part, allowMissingColumns=True)
    if tasks is not None:
        per_span = per_span.repartition(tasks, *span)
    length = F.col("w_end") - F.col("w_start")

    def share(part: Column) -> Column:
        return F.when(length > 0, F.least(F.lit(1.0), F.coalesce(part, F.lit(0.0)) / length)).otherwise(0.0)

    return (
        per_span.groupBy(*span)
        .agg(
            F.coalesce(F.sum("words"), F.lit(0.0)).alias("words"),
            F.coalesce(F.sum("hits"), F.lit(0)).alias("emotion_hits"),
            F.max("run_sec").alias("run_sec"),
            F.sum("quiet_sec").alias("quiet_sec"),
            F.max("peak_db").alias("peak_db"),
        F.max("peak_time_sec").alias("peak_time_sec"),
        )
        .select(
            *span,
            F.when(length > 0, F.col("words") / length).otherwise(0.0).alias("speech_density"),
            share(F.col("quiet_sec")).alias("silence_ratio"),
            "emotion_hits",
            share(F.col("run_sec")).alias("continuity_score"),
            "peak_db",
            "peak_time_sec",
        )
    )


def span_metrics(
    spans: DataFrame,
    segments: DataFrame,
    silence: DataFrame | None,
    loudness: DataFrame | None,
    keywords: Sequence[str] = (),
    width: float = 30.0,
    found: Heard | None = None,
) -> DataFrame:
    """Metrics of arbitrary spans ``(job_id, window_no, w_start, w_end)``, such as clips."""

    def place(df: DataFrame) -> DataFrame:
        return interval_join(
            df, spans, ["job_id"], ("start_sec", "end_sec"), ("w_start", "w_end"), width=width, closed=True
        )

    found = found or heard(segments, silence, keywords)
    touching = place(found.items)
    own = spans.select("job_id", "window_no", "w_start", "w_end").withColumn("kind", F.lit("span"))
    runs = with_runs(touching, ["job_id", "window_no"])
    return _measure(
        runs.unionByName(own, allowMissingColumns=True),
        phrase_hits(found.phrased, keywords, place),
        loudest_moment(loudness, place),
    )


def window_metrics(
    segments: DataFrame,
    silence: DataFrame,
    loudness: DataFrame | None,
    p: WindowParams = WindowParams(),
    lengths: DataFrame | None = None,
    found: Heard | None = None,
) -> DataFrame:
    """Metrics of every sliding window of every recording.

    Speech and silence are placed on blocks of windows together, so the data is
    shuffled once; what reaches the grouping is numbers only, added up by hash.
    """
    lengths = durations(segments, silence) if lengths is None else lengths
    tasks = tasks_for(segments)
    of_samples = tasks if loudness is None else tasks_of(loudness, loudness.count())
    found = found or heard(segments, silence, p.keywords)
    runs = with_runs(place_on_grid(found.items, lengths, p, tasks), ["job_id", "block"])

    def place(df: DataFrame, tasks: int = tasks) -> DataFrame:
        return to_windows(place_on_grid(df, lengths, p, tasks).where("kind is null"), p)

    return _measure(
        to_windows(runs, p), phrase_hits(found.phrased, p.keywords, place),
        loudest_moment(loudness, lambda samples: place(samples, of_samples)), tasks=max(tasks, of_samples),
    )


def excerpts(spans: DataFrame, segments: DataFrame, width: float = 30.0) -> DataFrame:
    """What is said inside each span ``(job_id, span_id, w_start, w_end)``, in order."""
    words = word_rows(segments).select(
        "job_id", "segment_id", "seg_start", "seg_end", "pos", "start_sec", "end_sec",
        F.trim("word").alias("said"),
    )
    whole = wordless_segments(segments).select(
        "job_id", "segment_id", F.col("start_sec").alias("seg_start"), F.col("end_sec").alias("seg_end"),
        F.lit(-1).alias("pos"), "start_sec", "end_sec", F.trim("text").alias("said"),
    )
    placed = interval_join(
        words.unionByName(whole), spans, ["job_id"], ("start_sec", "end_sec"), ("w_start", "w_end"),
        width=width,
    ).where(_inside())
    return placed.groupBy("job_id", "span_id").agg(
        tx.collapse(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seg_start", "segment_id", "pos", "said"))),
                lambda x: x["said"],
            )
        ).alias("excerpt")
    )
