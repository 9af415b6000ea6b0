"""Overlapping transcript chunks, prompts, model answers, and merged moments."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipstride.functions import responses as rs
from clipstride.functions import text as tx
from clipstride.functions.intervals import overlap_ratio
from clipstride.operators.greedy import keep_disjoint
from clipstride.operators.scan import ordinal, time_bucket
from clipstride.operators.store import written
from clipstride.operators.windows import excerpts

# Fixed values.
CHUNK_SEC = 600.0
CHUNK_STEP_SEC = 480.0
MERGE_RATIO = 0.3
HINT_PEAKS = 5
SHORTLIST = 12
BATCH = 20


def _sized(lengths: DataFrame, chunk: float, step: float) -> DataFrame:
    more = F.ceil((F.col("duration_sec") - chunk) / step).cast("long")
    return lengths.where("duration_sec > 0").withColumn(
        "n_chunks", F.when(F.col("duration_sec") <= chunk, F.lit(1).cast("long")).otherwise(more + 1)
    )


def _spans(df: DataFrame, chunk: float, step: float) -> DataFrame:
    start = F.col("chunk_no") * F.lit(step)
    return df.withColumn("c_start", start).withColumn("c_end", F.least(start + chunk, F.col("duration_sec")))


def chunks(lengths: DataFrame, segments: DataFrame, chunk: float = CHUNK_SEC, step: float = CHUNK_STEP_SEC) -> DataFrame:
    """Chunks of every recording that has a transcript."""
    spoken = lengths.join(segments.select("job_id").distinct(), "job_id", "left_semi")
    every = _sized(spoken, chunk, step).withColumn(
        "chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1))
    )
    return _spans(every, chunk, step).select("job_id", "chunk_no", "c_start", "c_end")


def into_chunks(
    df: DataFrame, lengths: DataFrame, start: str, end: str, chunk: float = CHUNK_SEC, step: float = CHUNK_STEP_SEC
) -> DataFrame:
    """Rows repeated for every chunk they may touch; callers apply the exact test."""
    lo = F.greatest(F.lit(0).cast("long"), F.floor((F.col(start) - chunk) / step).cast("long"))
    hi = F.least(F.col("n_chunks") - 1, F.ceil(F.col(end) / step).cast("long"))
    placed = (
        df.join(_sized(lengths, chunk, step), "job_id").withColumn("_lo", lo).withColumn("_hi", hi)
        .where("_lo <= _hi").withColumn("chunk_no", F.explode(F.sequence("_lo", "_hi")))
    )
    return _spans(placed, chunk, step).drop("_lo", "_hi", "n_chunks", "duration_sec")


_TOUCHES = "start_sec < c_end and end_sec > c_start"


def loudness_peaks(loudness: DataFrame, lengths: DataFrame, top: int = HINT_PEAKS) -> DataFrame:
    """The loudest samples of each chunk; the ranking is cut before the shuffle."""
    order = Window.partitionBy("job_id", "chunk_no").orderBy(F.desc("rms_db"), "time_sec")
    return (
        into_chunks(loudness, lengths, "time_sec", "time_sec").where("time_sec >= c_start and time_sec < c_end")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("job_id", "chunk_no", F.col("rank").cast("long").alias("rank"), "time_sec", "rms_db")
    )


def emotion_hints(
    segments: DataFrame, lengths: DataFrame, keywords: Sequence[str], hint_chars: int | None = None
) -> DataFrame:
    """Excited speech of each chunk, whole unless ``hint_chars`` says how much of it to show."""
    marked = segments.select(
        "job_id", "segment_id", "start_sec", "end_sec", tx.head(F.trim("text"), hint_chars).alias("hint"),
        tx.emotion_hits(F.col("text"), keywords).alias("hits"),
    ).where("hits > 0")
    return into_chunks(marked, lengths, "start_sec", "end_sec").where(_TOUCHES).select(
        "job_id", "chunk_no", "segment_id", F.col("start_sec").alias("time_sec"), "hint"
    )


def silence_hints(silence: DataFrame, lengths: DataFrame) -> DataFrame:
    spans = silence.select("job_id", "start_sec", "end_sec")
    return into_chunks(spans, lengths, "start_sec", "end_sec").where(_TOUCHES).select(
        "job_id", "chunk_no", F.greatest("start_sec", "c_start").alias("from_sec"),
        F.least("end_sec", "c_end").alias("to_sec"),
    )


# Our own wording; the sections and the answer format are what the parser expects.
INTRO = "Find the moments of this recording that would make good short clips. Chunk "
ANSWER = (
    'Answer with a JSON array only. Each item: "start_sec", "end_sec" (numbers, inside the chunk), '
    '"reason" (short text), "confidence" (0.0 to 1.0). Answer [] when nothing stands out.'
)
NO_SPEECH, NO_HINTS = "(nothing is said)", "(no hints)"
SECTIONS = {"peak": "Loudest moments:", "emotion": "Excited speech:", "silence": "Pauses:"}


def tenths(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.0"))


def whole(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0"))


def prompts(
    segments: DataFrame, silence: DataFrame, loudness: DataFrame | None, lengths: DataFrame, keywords: Sequence[str],
    hint_chars: int | None = None, peaks: int = HINT_PEAKS,
) -> DataFrame:
    """One prompt per chunk: stamped transcript, hints, and what to answer.

    ``hint_chars`` shortens hints (``functions.text.HINT_CHARS`` is a usual length), ``peaks`` is how many of the loudest samples to name.
    All lines are unioned and grouped once per chunk.
    """

    def lines(df: DataFrame, section: str, at: str, tie: str, line: Column) -> DataFrame:
        return df.select(
            "job_id", "chunk_no", F.lit(section).alias("section"),
            F.struct(F.expr(at).cast("double").alias("at"), F.expr(tie).cast("long").alias("tie"), line.alias("line"))
            .alias("x"),
        )

    said = into_chunks(segments.drop("words"), lengths, "start_sec", "end_sec").where(_TOUCHES)
    stamp = F.concat(F.lit("["), tenths(F.col("start_sec")), F.lit("s - "), tenths(F.col("end_sec")), F.lit("s] "),
                     F.trim("text"))
    rows = lines(said, "said", "start_sec", "segment_id", stamp)
    rows = rows.unionByName(lines(
        emotion_hints(segments, lengths, keywords, hint_chars), "emotion", "time_sec", "segment_id",
        F.concat(F.lit("- "), tenths(F.col("time_sec")), F.lit("s: "), F.col("hint")),
    ))
    rows = rows.unionByName(lines(
        silence_hints(silence, lengths), "silence", "from_sec", "0",
        F.concat(F.lit("- "), tenths(F.col("from_sec")), F.lit("s to "), tenths(F.col("to_sec")), F.lit("s")),
    ))
    if loudness is not None:
        rows = rows.unionByName(lines(
            loudness_peaks(loudness, lengths, peaks), "peak", "rank", "0",
            F.concat(F.lit("- "), tenths(F.col("time_sec")), F.lit("s: "), tenths(F.col("rms_db")), F.lit(" dB")),
        ))

    def gathered(section: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("section") == section, F.col("x"))))
        return F.array_join(F.transform(found, lambda x: x["line"]), "\n").alias(section)

    texts = rows.groupBy("job_id", "chunk_no").agg(*[gathered(s) for s in ("said", *SECTIONS)])
    hints = F.concat_ws(
        "\n\n",
        *[F.when(F.coalesce(F.col(s), F.lit("")) != "", F.concat(F.lit(head + "\n"), F.col(s)))
          for s, head in SECTIONS.items()],
    )
    said_text = F.coalesce(F.nullif(F.col("said"), F.lit("")), F.lit(NO_SPEECH))
    prompt = F.concat(
        F.lit(INTRO), whole(F.col("c_start")), F.lit("s to "), whole(F.col("c_end")), F.lit("s.\n\nTranscript:\n"),
        said_text, F.lit("\n\nHints:\n"), F.coalesce(F.nullif(hints, F.lit("")), F.lit(NO_HINTS)),
        F.lit("\n\n" + ANSWER),
    )
    return chunks(lengths, segments).join(texts, ["job_id", "chunk_no"], "left").select(
        "job_id", "chunk_no", "c_start", "c_end", prompt.alias("prompt")
    )


def answer(asked: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """Add ``raw``: a user-supplied model applied to Arrow batches of prompts."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(raw=generate(list(frame["prompt"])))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInPandas(batches, f"{fields}, raw string")


def parse_highlights(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per usable moment in each answer, with its place in it."""
    keep = [c for c in answers.columns if c != raw]
    return (
        answers.select(*keep, F.posexplode(rs.highlight_objects(F.col(raw))).alias("pos", "_obj"))
        .withColumn("_m", rs.moment_fields(F.col("_obj"))).where("_m is not null")
        .select(*keep, F.col("pos").cast("long").alias("pos"), "_m.*")
    )


def merge_moments(moments: DataFrame, arrival: Sequence[str], ratio: float = MERGE_RATIO) -> DataFrame:
    """Of moments sharing at least ``ratio`` of their extent keep the most confident.

    Equal confidence keeps the earlier arrival.
    """
    return keep_disjoint(
        moments, ["job_id"], "start_sec", "end_sec",
        [(-F.col("confidence")).alias("rank"), *map(F.col, arrival)],
        lambda k, x: overlap_ratio(k["s"], k["e"], x["s"], x["e"]) >= ratio,
    )


def moments_to_candidates(moments: DataFrame, segments: DataFrame, top_n: int | None = None) -> DataFrame:
    """Moments as clip candidates with the words spoken in them."""
    if top_n is not None:
        order = Window.partitionBy("job_id").orderBy(F.desc("confidence"), "start_sec", "moment_id")
        moments = moments.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top_n).drop("_n")
    spans = moments.select(
        "job_id", F.col("moment_id").alias("span_id"), F.col("start_sec").alias("w_start"), F.col("end_sec").alias("w_end")
    )
    said = excerpts(spans, segments).withColumnRenamed("span_id", "moment_id")
    return moments.join(said, ["job_id", "moment_id"], "left").select(
        "job_id", "moment_id", "start_sec", "end_sec", F.round("confidence", 6).alias("score"),
        F.coalesce("excerpt", F.lit("")).alias("excerpt"),
    )


def shortlist(
    moments: DataFrame, rank: Column | None = None, target: int = SHORTLIST, batch: int = BATCH
) -> DataFrame:
    """Cut each job's moments to ``target``: best of every stretch of time first.

    ``rank`` is the ranker's order (lower is better, null for what it did not list). Where it listed any moment of a
    stretch, the others of the stretch are out; in a stretch without a pick, and without ``rank``, confidence decides,
    and those come after all picks.
    A stretch is ``batch`` consecutive moments; places in time are counted per bucket,
    so no job is ordered by one task.
    """
    rank = F.lit(None).cast("double") if rank is None else rank.cast("double")
    placed = ordinal(
        moments.withColumn("_rank", rank), ["job_id"], time_bucket(F.col("start_sec"), 600.0),
        [F.col("start_sec"), F.col("end_sec"), F.col("moment_id")], "_at",
    )
    totals = moments.groupBy("job_id").agg(F.count(F.lit(1)).alias("_total"))
    n_batches = F.ceil(F.col("_total") / batch)
    keep = F.greatest(F.lit(1), F.ceil(F.lit(2 * target) / n_batches))
    best = [F.asc_nulls_last("_rank"), F.desc("confidence"), F.col("_at").asc()]
    in_batch = Window.partitionBy("job_id", "_batch").orderBy(*best)
    overall = Window.partitionBy("job_id").orderBy(*best)
    survivors = (
        placed.join(totals, "job_id").withColumn("_batch", F.floor(F.col("_at") / batch))
        .withColumn("_n", F.row_number().over(in_batch))
        .withColumn("_picked", F.count("_rank").over(Window.partitionBy("job_id", "_batch")) > 0)
        .where((F.col("_n") <= keep) & (F.col("_rank").isNotNull() | ~F.col("_picked")))
    )
    return (
        survivors.withColumn("_n", F.row_number().over(overall)).where(F.col("_n") <= target)
        .select(*moments.columns)
    )


def selection_prompts(
    moments: DataFrame, segments: DataFrame, target: int = SHORTLIST, batch: int = BATCH, excerpt_chars: int | None = None
) -> DataFrame:
    """One ranking prompt per stretch of ``batch`` moments, in order of time; ``excerpt_chars`` shortens what is said in them."""
    spans = moments.select(
        "job_id", F.col("moment_id").alias("span_id"), F.col("start_sec").alias("w_start"), F.col("end_sec").alias("w_end")
    )
    said = excerpts(spans, segments).withColumnRenamed("span_id", "moment_id")
    placed = ordinal(
        moments, ["job_id"], time_bucket(F.col("start_sec"), 600.0),
        [F.col("start_sec"), F.col("end_sec"), F.col("moment_id")], "_at",
    ).withColumn("batch_no", F.floor(F.col("_at") / batch).cast("long"))
    line = F.concat(
        F.lit("["), (F.col("_at") % batch).cast("string"), F.lit("] "), whole(F.col("start_sec")), F.lit("s: "),
        F.col("reason"), F.lit(" | "), tx.head(F.coalesce("excerpt", F.lit("")), excerpt_chars),
    )
    listed = placed.join(said, ["job_id", "moment_id"], "left").groupBy("job_id", "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("_at", line.alias("line")))).alias("lines")
    )
    text = F.concat(
        F.lit(f"Choose at most {target} of these moments, best first. Answer with a JSON array of their numbers.\n"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n"),
    )
    return listed.select("job_id", "batch_no", text.alias("prompt"))


def _ranked(rows: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """Let a model keep the best ``keep`` of each list ``(job_id, list_no)``, in its order.

    ``rows``: also idx (place in the list), size (of the list), keep, confidence and line. A list that is no longer than
    ``keep`` passes unasked. Where the answer names none of the list, confidence decides. Adds ``pos``, the place among the kept.
    """
    name = ["job_id", "list_no"]
    asked = rows.where("size > keep").groupBy(*name).agg(
        F.first("size").alias("size"), F.first("keep").alias("keep"), F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("lines"))
    prompt = F.concat(
        F.lit("Choose at most "), F.col("keep").cast("string"),
        F.lit(" of these moments, best first. Answer with a JSON array of their numbers.\n"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n"),
    )
    answers = written(answer(asked.select(*name, "size", "keep", prompt.alias("prompt")), generate))  # a model is dear
    named = answers.select(*name, F.slice(rs.index_list(F.col("raw"), F.col("size")), 1, F.col("keep").cast("int")).alias("named")).where(F.size("named") > 0)
    picks = named.select(*name, F.posexplode("named").alias("pick", "idx")).withColumn("idx", F.col("idx").cast("long"))
    joined = rows.join(named.select(*name, F.lit(True).alias("_answered")), name, "left").join(picks, [*name, "idx"], "left")
    sure = Window.partitionBy(*name).orderBy(F.desc("confidence"), "idx")  # one list, as long as a prompt
    pos = F.when(F.col("size") <= F.col("keep"), F.col("idx")).when(F.col("_answered"), F.col("pick")).otherwise(F.row_number().over(sure) - 1)
    return joined.withColumn("pos", pos.cast("long")).where(F.col("pos") < F.col("keep")).drop("_answered", "pick")


def ranked_shortlist(
    moments: DataFrame, segments: DataFrame, generate: Callable[[list[str]], list[str]], target: int = SHORTLIST, batch: int = BATCH
) -> DataFrame:
    """The ``target`` best moments of each job in a model's order, as ``moments`` with ``place`` (from 1).

    A job with no more than ``target`` moments keeps them in order of time. A model first ranks every ``batch`` consecutive
    moments in a prompt of their own, so that no part of a recording falls off the end of a long prompt, and then, where
    more than ``target`` survive, the survivors of the job. Lists are ranked as in ``_ranked``; its fallback holds list by list.
    """
    spans = moments.select(
        "job_id", F.col("moment_id").alias("span_id"), F.col("start_sec").alias("w_start"), F.col("end_sec").alias("w_end"))
    said = excerpts(spans, segments).withColumnRenamed("span_id", "moment_id")
    placed = ordinal(
        moments, ["job_id"], time_bucket(F.col("start_sec"), 600.0), [F.col("start_sec"), F.col("end_sec"), F.col("moment_id")], "_at")
    totals = moments.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    rest = [c for c in moments.columns if c not in ("job_id", "confidence")]
    rows = written(placed.join(totals, "job_id").join(said, ["job_id", "moment_id"], "left").select(
        "job_id", "confidence", F.struct(*rest).alias("row"), F.col("_at").alias("at"), "total",
        F.concat(whole(F.col("start_sec")), F.lit("s: "), F.col("reason"), F.lit(" | "), F.coalesce("excerpt", F.lit(""))).alias("told")))
    columns = ["job_id", "confidence", "row", "place"]

    def listed(df: DataFrame) -> DataFrame:
        return df.withColumn("line", F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.col("told")))

    lists = F.ceil(F.col("total") / batch)
    share = F.when(lists == 1, F.lit(target)).otherwise(F.greatest(F.lit(1), F.ceil(F.lit(2 * target) / lists)))
    first = rows.where(F.col("total") > target).withColumns(
        {"list_no": F.floor(F.col("at") / batch), "idx": F.col("at") % batch, "keep": share.cast("long")})
    size = F.least(F.lit(batch), F.col("total") - F.col("list_no") * batch)
    survivors = written(_ranked(listed(first.withColumn("size", size)), generate).drop("size", "keep", "idx", "line"))
    left = survivors.groupBy("job_id").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("job_id").orderBy("list_no", "pos")  # two lists long, or one moment of each list
    again = survivors.join(left, "job_id").withColumns(
        {"idx": (F.row_number().over(order) - 1).cast("long"), "list_no": F.lit(0).cast("long"), "keep": F.lit(target).cast("long")}).drop("pos")
    final = _ranked(listed(again), generate).withColumn("place", F.col("pos") + 1)
    few = rows.where(F.col("total") <= target).withColumn("place", F.col("at") + 1)
    return few.select(*columns).unionByName(final.select(*columns)).select("job_id", "confidence", "row.*", F.col("place").cast("long")).select(
        *moments.columns, "place")
