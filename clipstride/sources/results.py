"""Detector results, words, labels and candidates as files; frozen inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipstride.operators.scan import dealt, time_bucket
from clipstride.operators.windows import tasks_for
from clipstride.sources import schemas

PART_SEC = 600.0


def decode_words(words_json: Column) -> Column:
    """Stored word timings; missing, blank or malformed text gives an empty list."""
    parsed = F.from_json(words_json, schemas.STORED_WORDS)
    renamed = F.transform(
        parsed,
        lambda w: F.struct(w["word"].alias("word"), w["startSec"].alias("start_sec"), w["endSec"].alias("end_sec")),
    )
    return F.coalesce(renamed, F.from_json(F.lit("[]"), schemas.WORDS))


def encode_words(words: Column) -> Column:
    stored = F.transform(
        words,
        lambda w: F.struct(w["word"].alias("word"), w["start_sec"].alias("startSec"), w["end_sec"].alias("endSec")),
    )
    return F.when(F.size(words) > 0, F.to_json(stored))


def coalesce_spellings(candidates: DataFrame) -> DataFrame:
    """Candidates written with either spelling of their fields; absent means 0."""
    zero = F.lit(0.0)
    return candidates.select(
        *[c for c in candidates.columns if c not in ("start_sec", "startSec", "end_sec", "endSec", "score")],
        F.coalesce("start_sec", "startSec", zero).alias("start_sec"),
        F.coalesce("end_sec", "endSec", zero).alias("end_sec"),
        F.coalesce("score", zero).alias("score"),
    )


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return coalesce_spellings(spark.read.schema(schemas.CANDIDATES_JSON).json(path, multiLine=True))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELS).json(path, multiLine=True).withColumn("note", F.coalesce("note", F.lit("")))


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from files of one JSON object a line, which many tasks read."""
    return spark.read.schema(schemas.LABELS).json(path).withColumn("note", F.coalesce("note", F.lit("")))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULT).json(path)


def result_tables(results: DataFrame) -> dict[str, DataFrame]:
    """The four tall tables of delivered results; missing lists count as empty."""
    words = F.transform(
        "s.words",
        lambda w: F.struct(w["word"].alias("word"), w["startSec"].alias("start_sec"), w["endSec"].alias("end_sec")),
    )
    job = F.col("jobId").alias("job_id")
    place = (F.coalesce("part", F.lit(0).cast("long")) * 2**20 + F.col("n")).alias("segment_id")

    def rows(column: str) -> DataFrame:
        return results.select(job, "part", F.posexplode(column).alias("n", "s"))

    return {
        "segments": rows("transcriptSegments").select(
            "job_id", place, F.col("s.startSec").alias("start_sec"), F.col("s.endSec").alias("end_sec"),
            F.col("s.text").alias("text"), F.col("s.wordCount").alias("word_count"),
            F.coalesce(words, F.from_json(F.lit("[]"), schemas.WORDS)).alias("words"),
        ),
        "silence": rows("silenceSegments").select(
            "job_id", F.col("s.startSec").alias("start_sec"), F.col("s.endSec").alias("end_sec"),
            F.col("s.durationSec").alias("duration_sec"),
        ),
        "windows": rows("analysisWindows").select(
            "job_id", F.col("s.startSec").alias("start_sec"), F.col("s.endSec").alias("end_sec"),
            F.col("s.speechDensity").alias("speech_density"), F.col("s.silenceRatio").alias("silence_ratio"),
            F.col("s.emotionHits").alias("emotion_hits"), F.col("s.continuityScore").alias("continuity_score"),
            F.col("s.totalScore").alias("total_score"),
        ),
        "candidates": rows("clipCandidates").select(
            "job_id", F.col("s.startSec").alias("start_sec"), F.col("s.endSec").alias("end_sec"),
            F.col("s.score").alias("score"), F.col("s.transcriptExcerpt").alias("excerpt"),
        ),
    }


def nested_results(
    segments: DataFrame, silence: DataFrame, windows: DataFrame, candidates: DataFrame, lengths: DataFrame,
    part_sec: float = PART_SEC,
) -> DataFrame:
    """Results as nested documents with ordered arrays, in parts of ``part_sec``.

    A recording of any length becomes documents of bounded size; ``result_tables``
    reads them back.  All rows are grouped once, in as many tasks as the words need;
    documents pass by a table of the lengths, so they are not sorted again.
    """
    camel = F.transform(
        F.col("words"),
        lambda w: F.struct(w["word"].alias("word"), w["start_sec"].alias("startSec"), w["end_sec"].alias("endSec")),
    )
    start, end = F.col("start_sec").alias("startSec"), F.col("end_sec").alias("endSec")

    def rows(df: DataFrame, name: str, *fields: Column) -> DataFrame:
        return df.select(
            "job_id", time_bucket(F.col("start_sec"), part_sec).alias("part"), F.struct(start, end, *fields).alias(name)
        )

    c = F.col
    sources = {
        "transcriptSegments": rows(segments, "transcriptSegments", c("text"), c("word_count").alias("wordCount"),
                                   camel.alias("words")),
        "silenceSegments": rows(silence, "silenceSegments", c("duration_sec").alias("durationSec")),
        "analysisWindows": rows(
            windows, "analysisWindows", c("speech_density").alias("speechDensity"), c("silence_ratio").alias("silenceRatio"),
            c("emotion_hits").alias("emotionHits"), c("continuity_score").alias("continuityScore"),
            c("total_score").alias("totalScore")),
        "clipCandidates": rows(candidates, "clipCandidates", c("score"), c("excerpt").alias("transcriptExcerpt")),
    }
    every = None
    for df in sources.values():
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    rows_of = dealt(every, tasks_for(segments), "job_id", "part")
    parts = rows_of.groupBy("job_id", "part").agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in sources])
    return parts.join(lengths.hint("shuffle_hash"), "job_id").select(
        F.col("job_id").alias("jobId"), "part", F.col("duration_sec").alias("durationSec"), *sources
    )


@dataclass(frozen=True)
class Request:
    """A detector's complete input."""

    segments: DataFrame
    silence: DataFrame
    loudness: DataFrame
    params: DataFrame


PARAMS = (
    "job_id long, duration_sec double, window_duration_sec double, step_sec double, top_n int, "
    "min_overlap_ratio double, emotion_keywords array<string>"
)
TABLES = ("segments", "silence", "loudness", "params")


def freeze(request: Request, path: str) -> None:
    """Write a detector's input so that it can be replayed exactly."""
    for name in TABLES:
        getattr(request, name).write.mode("overwrite").parquet(f"{path}/{name}")


def replay(spark: SparkSession, path: str) -> Request:
    """Read a frozen input; absent settings get their defaults."""
    shapes = {"segments": schemas.SEGMENTS, "silence": schemas.SILENCE, "loudness": schemas.LOUDNESS, "params": PARAMS}
    tables = {n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in shapes.items()}
    tables["params"] = tables["params"].withColumns({
        "window_duration_sec": F.coalesce("window_duration_sec", F.lit(30.0)),
        "step_sec": F.coalesce("step_sec", F.lit(5.0)),
        "min_overlap_ratio": F.coalesce("min_overlap_ratio", F.lit(0.0)),
    })
    return Request(**tables)
