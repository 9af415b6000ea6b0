"""Word-timed captions for clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipstride.functions.labels import caption_time, karaoke
from clipstride.operators.joins import interval_join
from clipstride.operators.windows import word_rows

WORDS_PER_PHRASE = 5

# The caption file's header, and the vertical margin in both modes.
MARGIN_V, MARGIN_V_VERTICAL = 200, 340
STYLE_FIELDS = (
    "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, "
    "Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, "
    "MarginL, MarginR, MarginV, Encoding"
)
STYLE_HEAD = (
    "Karaoke,Arial,56,&H00FFFFFF,&H0000FFFF,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,3,1,2,40,40"
)
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def header(vertical: bool = False) -> str:
    margin = MARGIN_V_VERTICAL if vertical else MARGIN_V
    return "\n".join([
        "[Script Info]", "ScriptType: v4.00+", "PlayResX: 1920", "PlayResY: 1080", "WrapStyle: 0",
        "ScaledBorderAndShadow: yes", "", "[V4+ Styles]", f"Format: {STYLE_FIELDS}",
        f"Style: {STYLE_HEAD},{margin},1", "", "[Events]", f"Format: {EVENT_FIELDS}", "",
    ])


def clip_words(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """Words that lie wholly inside each clip ``(job_id, candidate_id, clip_start, clip_end)``."""
    words = word_rows(segments).where("start_sec is not null and end_sec is not null")
    near = interval_join(
        words, clips, ["job_id"], ("start_sec", "end_sec"), ("clip_start", "clip_end"), closed=True
    )
    return near.where("start_sec >= clip_start and end_sec <= clip_end").select(
        "job_id", "candidate_id", "seg_start", "segment_id", "pos", "word", "start_sec", "end_sec"
    )


def caption_words(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """Words heard in each clip, cut to it and timed from its start."""
    near = interval_join(
        word_rows(segments), clips, ["job_id"], ("start_sec", "end_sec"), ("clip_start", "clip_end")
    )
    return near.select(
        "job_id", "candidate_id", "seg_start", "segment_id", "pos", F.trim("word").alias("word"),
        (F.greatest("start_sec", "clip_start") - F.col("clip_start")).alias("start_sec"),
        (F.least("end_sec", "clip_end") - F.col("clip_start")).alias("end_sec"),
    ).where("end_sec > start_sec")


def phrases(words: DataFrame, size: int = WORDS_PER_PHRASE) -> DataFrame:
    """Consecutive words of a clip in groups of ``size``; the clip bounds the ordering."""
    order = Window.partitionBy("job_id", "candidate_id").orderBy("seg_start", "segment_id", "pos")
    numbered = words.withColumn("n", F.row_number().over(order) - 1)
    grouped = numbered.groupBy(
        "job_id", "candidate_id", F.floor(F.col("n") / size).cast("long").alias("phrase_no")
    ).agg(F.array_sort(F.collect_list(F.struct("n", "word", "start_sec", "end_sec"))).alias("words"))
    return grouped.select(
        "job_id", "candidate_id", "phrase_no", F.element_at("words", 1)["start_sec"].alias("start_sec"),
        F.element_at("words", -1)["end_sec"].alias("end_sec"), "words",
    )


def caption_events(grouped: DataFrame, time_offset: Column | float = 0.0) -> DataFrame:
    """One caption line per phrase, shifted by the offset of the export's seek point."""
    offset = time_offset if isinstance(time_offset, Column) else F.lit(float(time_offset))
    line = F.concat(
        F.lit("Dialogue: 0,"), caption_time(F.col("start_sec") + offset), F.lit(","),
        caption_time(F.col("end_sec") + offset), F.lit(",Karaoke,,0,0,0,,"), karaoke(F.col("words")),
    )
    return grouped.select("job_id", "candidate_id", "phrase_no", line.alias("line"))


def caption_documents(
    clips: DataFrame, segments: DataFrame, *, vertical: bool = False, time_offset: Column | float = 0.0
) -> DataFrame:
    """One caption file per clip; clips without words have none."""
    events = caption_events(phrases(caption_words(clips, segments)), time_offset)
    lines = F.array_sort(F.collect_list(F.struct("phrase_no", "line")))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return events.groupBy("job_id", "candidate_id").agg(
        F.concat(F.lit(header(vertical)), body, F.lit("\n")).alias("content")
    )
