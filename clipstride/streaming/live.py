"""Windows, sessions, joins and upserts over live streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipstride.operators import events as ev
from clipstride.operators import lifecycle as op
from clipstride.operators.store import scope, written
from clipstride.operators.windows import WORD_GAP_SEC
from clipstride.sources import results, tables

TASKS = (
    "task_id long, job_id long, task_type string, status string, attempt_count long, max_attempts long, "
    "last_heartbeat_at timestamp_ntz, available_at timestamp_ntz, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, finished_at timestamp_ntz, claimed_at timestamp_ntz, failure_message string"
)
PROJECTION = (
    "job_id long, stored_status string, projected_status string, progress_percent long, progress_message string, "
    "updated_at timestamp_ntz, current_worker_id string, finished_at timestamp_ntz"
)
RESULT_TABLES = {
    "segments": "job_id long, segment_id long, start_sec double, end_sec double, text string, word_count int, "
                "words array<struct<word:string,start_sec:double,end_sec:double>>",
    "silence": "job_id long, start_sec double, end_sec double, duration_sec double",
    "windows": "job_id long, start_sec double, end_sec double, speech_density double, silence_ratio double, "
               "emotion_hits long, continuity_score double, total_score double",
    "candidates": "job_id long, start_sec double, end_sec double, score double, excerpt string",
}


def failure_rate(events: DataFrame, window: str = "15 minutes", slide: str = "1 minute", lateness: str = "1 minute"):
    """``events(ts, outcome)``: the alert over sliding windows."""
    return ev.failure_rate(events.withWatermark("ts", lateness), window, slide)


def backlog(samples: DataFrame, window: str = "5 minutes", slide: str = "1 minute", lateness: str = "1 minute"):
    """``samples(ts, queue, depth)``: queues that stay deep for a whole window."""
    return ev.backlog(samples.withWatermark("ts", lateness), window, slide)


def frequent_recovery(actions: DataFrame, window: str = "15 minutes", slide: str = "1 minute", lateness: str = "1 minute"):
    return ev.frequent(actions.withWatermark("ts", lateness), window, slide)


def chat_density(chat: DataFrame, window: str = "60 seconds", slide: str = "5 seconds", lateness: str = "10 seconds"):
    """``chat(job_id, ts)``: messages per recording in sliding windows."""
    return (
        chat.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide), "job_id")
        .agg(F.count(F.lit(1)).alias("messages"))
        .select("job_id", F.col("window.start").alias("window_start"), "messages")
    )


def speech_sessions(words: DataFrame, gap: float = WORD_GAP_SEC, lateness: str = "10 seconds") -> DataFrame:
    """``words(job_id, ts, start_sec, end_sec)``: continuous speech as sessions.

    A word keeps its session open until its own end plus the allowed pause.
    """
    hold = F.concat(F.round(F.col("end_sec") - F.col("start_sec") + gap, 6).cast("decimal(18,6)").cast("string"),
                    F.lit(" seconds"))
    return (
        words.withWatermark("ts", lateness).groupBy(F.session_window("ts", hold), "job_id")
        .agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count(F.lit(1)).alias("words"))
        .select("job_id", "start_sec", "end_sec", "words")
    )


def admit(callbacks: DataFrame, jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """Callbacks with the reason to reject them, against the current tables."""
    return op.admit_callbacks(callbacks, jobs, executions)


def project_live(jobs: DataFrame, tasks_path: str, projection_path: str, buckets: int = tables.BUCKETS):
    """A batch handler: upsert task updates, then project the jobs they touch.

    A job goes on from its own last projection, so that success of an earlier step that is heard of late does not
    take it back, unless its row in ``jobs`` has got another status since: then from that row.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scope(spark):
            project(spark, batch)

    def project(spark: SparkSession, batch: DataFrame) -> None:
        rows = written(batch)
        touched = written(rows.select("job_id").distinct())
        stored = tables.stored_jobs(spark, tasks_path, TASKS, touched, buckets)
        current = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        rest = [c for c in rows.columns if c != "task_id"]
        latest = written(
            current.groupBy("task_id")
            .agg(F.max(F.struct("updated_at", "_new", F.struct(*rest).alias("row"))).alias("best"))
            .select("task_id", "best.row.*").select(*rows.columns)
        )
        tables.replace_jobs(latest, touched, tasks_path, TASKS, buckets, within=True)
        rows_of = jobs.join(tables.keys_of(touched), "job_id", "left_semi")
        last = tables.stored_jobs(spark, projection_path, PROJECTION, touched, buckets)
        goes_on = last.select("job_id", F.col("stored_status").alias("_based_on"), F.struct(*[c for c in last.columns if c != "job_id"]).alias("_last"))
        known = rows_of.join(goes_on.hint("merge"), "job_id", "left").withColumn("_on", F.coalesce(F.col("_based_on") == F.col("status"), F.lit(False)))
        named = {"status": "projected_status"} | {c: c for c in ("progress_percent", "progress_message", "updated_at", "current_worker_id", "finished_at")}
        known = known.withColumns({c: F.when(F.col("_on"), F.col(f"_last.{p}")).otherwise(F.col(c)) for c, p in named.items()})
        projected = op.project_status(known.drop("_based_on", "_last", "_on"), latest).drop("stored_status").join(
            rows_of.select("job_id", F.col("status").alias("stored_status")).hint("merge"), "job_id")
        tables.replace_jobs(projected, touched, projection_path, PROJECTION, buckets, within=True)

    return handle


def ingest_results(root: str, buckets: int = tables.BUCKETS):
    """A batch handler: parts of a job's newest result add to what is stored of it.

    The parts delivered so far are kept as a table of their own. A part replaces the same part of its version, a higher version
    drops the parts of lower ones, and a lower version that comes late is not taken, whatever batches they came in.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields) + ", job_id bigint"
        with scope(spark):
            fresh = written(batch.withColumn("job_id", F.col("jobId").cast("long")))
            jobs = written(fresh.select("job_id").distinct())
            stored = tables.stored_jobs(spark, f"{root}/deliveries", shape, jobs, buckets)
            known = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
            newest = known.groupBy("jobId").agg(F.max(F.struct("processingVersion", "executionId")).alias("v"))
            latest = Window.partitionBy("jobId", "part").orderBy(F.desc("_new"))
            current = written(
                known.join(newest.select("jobId", "v.*").hint("merge"), ["jobId", "processingVersion", "executionId"], "left_semi")
                .withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(*fresh.columns)
            )
            for name, rows in results.result_tables(current.drop("job_id")).items():
                tables.replace_jobs(rows, jobs, f"{root}/{name}", RESULT_TABLES[name], buckets, within=True)
            # last, so that a batch that is repeated finds what it found before
            tables.replace_jobs(current, jobs, f"{root}/deliveries", shape, buckets, within=True)

    return handle
