"""The streaming operators replayed from files; each equals its batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.catalog import SQL, lifecycle, query
from clipstride.catalog.inputs import Tables, add_view
from clipstride.functions.lifecycle import lookup
from clipstride.operators.store import fresh_path, written
from clipstride.operators.windows import durations
from clipstride.sources import tables
from clipstride.sources.results import nested_results
from clipstride.sources.schemas import RESULT
from clipstride.streaming import live, state
from clipstride.streaming.run import drain, drain_batches, stateful, stream_of

FAR = "2030-01-01"


def _stream(name: str, twin: str):
    """Register a stream under the SQL of its batch twin."""

    def register(fn):
        query(name)(fn)
        SQL[name] = SQL[twin]
        return fn

    return register


@_stream("stream_progress_throttle", "progress_throttle")
def stream_progress_throttle(t: Tables) -> DataFrame:
    stateful(t.spark)
    updates = stream_of(lifecycle.progress_updates(t))
    return drain(state.throttle(updates, lifecycle.THROTTLE_US)).select("job_id", "event_id")


@_stream("stream_high_water_mark", "high_water_mark")
def stream_high_water_mark(t: Tables) -> DataFrame:
    stateful(t.spark)
    marks = stream_of(t.job_events.select("job_id", "event_id", "us", F.col("k").alias("value")))
    return drain(state.high_water_mark(marks)).select("job_id", "event_id", F.col("value").alias("k"))


@_stream("stream_heartbeat_watchdog", "stale_tasks")
def stream_heartbeat_watchdog(t: Tables) -> DataFrame:
    """All heartbeats; a last one on the reference date moves the clock there, and reports due after it are not of that date."""
    stateful(t.spark)
    as_of = lifecycle.when(lifecycle.AS_OF)
    now = F.unix_micros(as_of.cast("timestamp"))
    beat = F.col("last_heartbeat_at")
    beats = t.tasks.where(beat.isNotNull()).select(
        "task_id", "task_type", "status", F.unix_micros(beat.cast("timestamp")).alias("us"), beat.cast("timestamp").alias("ts")
    )
    clock = t.spark.range(1).select(
        F.lit(-1).cast("long").alias("task_id"), F.lit("EXPORT").alias("task_type"), F.lit("SUCCEEDED").alias("status"),
        now.alias("us"), as_of.cast("timestamp").alias("ts"),
    )
    found = drain(state.watchdog(stream_of(beats.unionByName(clock)), lifecycle.STALE_DAYS))
    allowed = lookup(F.col("task_type"), {k: F.lit(v).cast("long") for k, v in lifecycle.STALE_DAYS.items()})
    due = found.where(F.col("last_heartbeat_us") + allowed * 1_000_000 < now).select("task_id", "last_heartbeat_us")
    return due.join(t.tasks.select("task_id", "job_id", "task_type"), "task_id").select(
        "task_id", "job_id", "task_type",
        F.date_format(F.timestamp_micros("last_heartbeat_us"), "yyyy-MM-dd HH:mm").alias("last_heartbeat_at"),
    )


@_stream("stream_status_projection", "job_status_projection")
def stream_status_projection(t: Tables) -> DataFrame:
    tasks, projection = fresh_path(t.spark), fresh_path(t.spark)
    jobs = written(t.jobs)
    columns = [c.split()[0] for c in live.TASKS.split(", ")]
    drain_batches(stream_of(t.tasks.select(*columns)), live.project_live(jobs, tasks, projection, buckets=8))
    touched = tables.read_by_job(t.spark, projection, live.PROJECTION)
    quiet = jobs.join(tables.keys_of(touched), "job_id", "left_anti").select(
        "job_id", F.col("status").alias("stored_status"), F.col("status").alias("projected_status"), "progress_percent",
        "progress_message", "updated_at", "current_worker_id", "finished_at",
    )
    return touched.unionByName(quiet).select(
        "job_id", "stored_status", "projected_status", "progress_percent", "progress_message",
        lifecycle.day("updated_at"), "current_worker_id", lifecycle.day("finished_at"),
    )


@query("stream_forward_projection", """
    select job_id, status as stored_status, case when status in ('CANCELED', 'FAILED', 'READY_FOR_REVIEW', 'EXPORTING_CLIP', 'COMPLETED') then status
           else 'READY_FOR_REVIEW' end as projected_status from jobs""")
def stream_forward_projection(t: Tables) -> DataFrame:
    """Three triggers: the analysis ends, the download before it is heard of, and an outdated row comes last."""
    at, projection = fresh_path(t.spark), fresh_path(t.spark)
    jobs = written(t.jobs)
    names = [c.split()[0] for c in live.TASKS.split(", ")]

    def trigger(n: int, kind: str, status: str, day: int) -> DataFrame:
        when = F.lit(f"2000-01-{day:02}").cast("timestamp_ntz")
        known = {"task_id": F.col("job_id") * 10 + n, "job_id": F.col("job_id"), "task_type": F.lit(kind), "status": F.lit(status),
                 "attempt_count": F.lit(1).cast("long"), "updated_at": when, "finished_at": when}
        kinds = dict(c.split() for c in live.TASKS.split(", "))
        return jobs.select(*[known.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in names])

    handle = live.project_live(jobs, at, projection, buckets=8)
    for update in (trigger(1, "ANALYZE", "SUCCEEDED", 3), trigger(2, "DOWNLOAD", "SUCCEEDED", 4), trigger(1, "ANALYZE", "QUEUED", 2)):
        drain_batches(stream_of(update), handle)
    return tables.read_by_job(t.spark, projection, live.PROJECTION).select("job_id", "stored_status", "projected_status")


@_stream("stream_callback_admission", "callback_admission")
def stream_callback_admission(t: Tables) -> DataFrame:
    callbacks = stream_of(lifecycle.callback_rows(t.table("events")))
    return drain(live.admit(callbacks, t.jobs, t.executions)).select("event_id", "reject_reason")


def _with_clock(rows: DataFrame, **values) -> DataFrame:
    """Append one row far in the future, which closes every window before it."""
    clock = rows.sparkSession.range(1).select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    )
    return rows.unionByName(clock)


def _far():
    return F.lit(FAR).cast("timestamp")


@_stream("stream_failure_rate", "failure_rate_windows")
def stream_failure_rate(t: Tables) -> DataFrame:
    rows = t.job_events.where("event_type in ('EXPORT_COMPLETED', 'JOB_FAILED')").select(
        F.timestamp_micros("us").alias("ts"),
        F.when(F.col("event_type") == "JOB_FAILED", "failed").otherwise("completed").alias("outcome"),
    )
    found = drain(live.failure_rate(stream_of(_with_clock(rows, ts=_far())), "15 hours", "1 hour"))
    return found.select(lifecycle._hour(), "completed", "failed", "rate", "alert")


@_stream("stream_backlog", "backlog_windows")
def stream_backlog(t: Tables) -> DataFrame:
    rows = t.job_events.select(F.timestamp_micros("us").alias("ts"), F.col("stage").alias("queue"), F.col("k").alias("depth"))
    found = drain(live.backlog(stream_of(_with_clock(rows, ts=_far())), "5 hours", "1 hour"))
    return found.select(lifecycle._hour(), "queue", "least_depth", "alert")


@_stream("stream_stale_recovery", "stale_windows")
def stream_stale_recovery(t: Tables) -> DataFrame:
    rows = t.job_events.where("event_type = 'JOB_FAILED'").select(F.timestamp_micros("us").alias("ts"))
    found = drain(live.frequent_recovery(stream_of(_with_clock(rows, ts=_far())), "15 hours", "1 hour"))
    return found.select(lifecycle._hour(), "actions", "alert")


@query("stream_chat_density", """
    select job_id, slot * 5 as window_sec, count(*) as messages
    from (select job_id, unnest(range(floor(offset_sec / 5)::bigint - 11, floor(offset_sec / 5)::bigint + 1)) as slot from chat)
    group by job_id, slot""")
def stream_chat_density(t: Tables) -> DataFrame:
    rows = t.chat.select("job_id", F.timestamp_seconds("offset_sec").alias("ts"))
    found = drain(live.chat_density(stream_of(_with_clock(rows, ts=_far()))))
    return found.select("job_id", F.unix_seconds("window_start").alias("window_sec"), "messages")


add_view("speech_islands", """
    select job_id, min(start_sec) as start_sec, max(end_sec) as end_sec, count(*) as n_words
    from (select *, sum(opens) over (partition by job_id order by start_sec, end_sec rows between unbounded preceding and current row) as island
          from (select *, case when before is null or start_sec > before + 0.6e0 then 1 else 0 end as opens
                from (select *, max(end_sec) over (partition by job_id order by start_sec, end_sec
                        rows between unbounded preceding and 1 preceding) as before from words)))
    group by job_id, island""")


@query("speech_sessions", "select job_id, start_sec, end_sec, n_words from speech_islands")
def speech_sessions(t: Tables) -> DataFrame:
    """Runs of continuous speech of whole recordings."""
    from clipstride.operators.scan import islands
    from clipstride.operators.windows import WORD_GAP_SEC, word_rows

    words = written(word_rows(t.segments).select("job_id", "start_sec", "end_sec"))
    runs = islands(words, ["job_id"], "start_sec", "end_sec", gap=WORD_GAP_SEC)
    return runs.groupBy("job_id", "island_start").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count(F.lit(1)).alias("n_words")
    ).drop("island_start")


@_stream("stream_speech_sessions", "speech_sessions")
def stream_speech_sessions(t: Tables) -> DataFrame:
    from clipstride.operators.windows import word_rows

    words = word_rows(t.segments).select(
        "job_id", F.timestamp_millis(F.round(F.col("start_sec") * 1000).cast("long")).alias("ts"), "start_sec", "end_sec"
    )
    clock = _with_clock(words, ts=_far(), start_sec=F.lit(0.0), end_sec=F.lit(1.0))
    return drain(live.speech_sessions(stream_of(clock))).withColumnRenamed("words", "n_words")


def _windows(t: Tables) -> DataFrame:
    """Windows as an analysis might deliver them."""
    return t.moments.select(
        "job_id", "start_sec", "end_sec", (F.col("end_sec") - F.col("start_sec")).alias("speech_density"), F.lit(0.25).alias("silence_ratio"),
        (F.col("moment_id") % 5).alias("emotion_hits"), F.lit(0.5).alias("continuity_score"), F.col("confidence").alias("total_score"))


def _delivery(t: Tables, n: int) -> DataFrame:
    """Segments, silence, windows and candidates as results of version ``n``, in parts of a minute per recording."""
    candidates = t.moments.select("job_id", "start_sec", "end_sec", F.col("confidence").alias("score"), F.col("reason").alias("excerpt"))
    docs = nested_results(t.segments, t.silence, _windows(t), candidates, durations(t.segments, t.silence), 60.0)
    rows = docs.withColumn("processingVersion", F.lit(n).cast("long")).withColumn("executionId", F.lit(n).cast("long"))
    return t.spark.createDataFrame([], RESULT).unionByName(rows, allowMissingColumns=True)


@query("stream_result_ingest_batches", "select job_id, start_sec, end_sec, text, word_count from segments")
def stream_result_ingest_batches(t: Tables) -> DataFrame:
    """Parts of one version over two batches, one of them twice, an older version last."""
    root = fresh_path(t.spark)
    handle = live.ingest_results(root, buckets=8)
    new, old = _delivery(t, 2), _delivery(t, 1)
    for batch in (new.where("part % 2 = 0"), new.where("part % 2 = 1 or part = 0"), old):
        drain_batches(stream_of(batch), handle)
    stored = tables.read_by_job(t.spark, f"{root}/segments", live.RESULT_TABLES["segments"])
    return stored.select("job_id", "start_sec", "end_sec", "text", "word_count")


@query("stream_result_ingest", """
    select job_id, count(*) as n_segments, sum(word_count)::bigint as n_words from segments group by job_id""")
def stream_result_ingest(t: Tables) -> DataFrame:
    """Results delivered twice, an outdated version first; each job is stored once."""
    root = fresh_path(t.spark)
    version = lambda n: _delivery(t, n)
    old = version(1).withColumn("transcriptSegments", F.slice("transcriptSegments", 1, 1))
    delivered = old.unionByName(version(2)).unionByName(version(2))
    drain_batches(stream_of(delivered), live.ingest_results(root, buckets=8))
    stored = tables.read_by_job(t.spark, f"{root}/segments", live.RESULT_TABLES["segments"])
    return stored.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("word_count").alias("n_words")
    )


@query("stream_result_ingest_tables", """
    select 'segments' as kind, job_id, start_sec::double as start_sec, end_sec::double as end_sec, word_count::double as value, text as said from segments
    union all select 'silence', job_id, start_sec, end_sec, round(end_sec - start_sec, 6), null from silence
    union all select 'windows', job_id, start_sec, end_sec, confidence, (moment_id % 5)::varchar from moments where job_id in (select job_id from segments)
    union all select 'candidates', job_id, start_sec, end_sec, confidence, reason from moments where job_id in (select job_id from segments)""")
def stream_result_ingest_tables(t: Tables) -> DataFrame:
    """All four lists of results over two batches, an older version last."""
    root = fresh_path(t.spark)
    handle = live.ingest_results(root, buckets=8)
    new, old = written(_delivery(t, 2)), _delivery(t, 1)
    for batch in (new.where("part % 2 = 0"), new.where("part % 2 = 1"), old.where("part = 0")):
        drain_batches(stream_of(batch), handle)
    value = {"segments": ("word_count", "text"), "silence": ("duration_sec", None), "windows": ("total_score", "emotion_hits"), "candidates": ("score", "excerpt")}
    out = None
    for name, (number, said) in value.items():
        rows = tables.read_by_job(t.spark, f"{root}/{name}", live.RESULT_TABLES[name]).select(
            F.lit(name).alias("kind"), "job_id", "start_sec", "end_sec", F.col(number).cast("double").alias("value"),
            (F.col(said) if said else F.lit(None)).cast("string").alias("said"))
        out = rows if out is None else out.unionByName(rows)
    return out
