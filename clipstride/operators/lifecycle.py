"""Reports over jobs, tasks, executions and candidates.

``as_of`` is always a parameter; nothing reads the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipstride.functions import lifecycle as lc
from clipstride.operators.scan import ordinal


def latest_per_job(rows: DataFrame, id_column: str, key: str = "job_id") -> DataFrame:
    """The row with the greatest id per key, by one partial aggregate and no sort."""
    rest = [c for c in rows.columns if c not in (key, id_column)]
    best = F.max(F.struct(id_column, F.struct(*rest).alias("row"))).alias("best")
    return rows.groupBy(key).agg(best).select(key, f"best.{id_column}", "best.row.*").select(*rows.columns)


def job_list(jobs: DataFrame, executions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs with their latest execution and latest task, oldest first."""
    last_run = latest_per_job(
        executions.select("job_id", "execution_id", "worker_id", F.col("status").alias("execution_status")),
        "execution_id",
    )
    last_task = latest_per_job(
        tasks.select("job_id", "task_id", "task_type", F.col("status").alias("task_status")), "task_id"
    )
    return (
        jobs.join(last_run, "job_id", "left").join(last_task, "job_id", "left").orderBy("created_at", "job_id")
    )


def children_of(rows: DataFrame, job_id: int, *order: str) -> DataFrame:
    """The rows of one job in a stable order; the filter reaches the scan."""
    return rows.where(F.col("job_id") == job_id).orderBy(*order)


def children_in_order(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of all jobs in the same stable order, by a range-partitioned sort."""
    return rows.orderBy("job_id", *order)


# What a task says about its job.
QUEUED_AS = {"DOWNLOAD": "QUEUED_FOR_DOWNLOAD", "ANALYZE": "QUEUED_FOR_PROCESSING", "EXPORT": "EXPORTING_CLIP"}
CLAIMED_AS = {"DOWNLOAD": "DOWNLOADING", "ANALYZE": "EXTRACTING_AUDIO", "EXPORT": "EXPORTING_CLIP"}
QUEUED_MESSAGE = {
    "DOWNLOAD": "Queued for download worker",
    "ANALYZE": "Source video is ready and queued for processing",
    "EXPORT": "Queued for clip export",
}
CLAIMED_MESSAGE = {
    "DOWNLOAD": "Download worker claimed job and started source materialization",
    "ANALYZE": "Processing worker claimed job and started analysis pipeline",
    "EXPORT": "Worker claimed export task",
}
RETRY_MESSAGE = {
    "DOWNLOAD": "Download worker retry attempt ",
    "ANALYZE": "Processing worker retry attempt ",
    "EXPORT": "Export worker retry attempt ",
}
READY_MESSAGE = "Analysis completed"


def deciding_task(tasks: DataFrame) -> DataFrame:
    """Per job the task that speaks for it: the most advanced open one, else the newest."""
    status, kind = F.col("status"), F.col("task_type")
    urgency = F.coalesce(lc.lookup(status, {"RUNNING": 3, "CLAIMED": 2, "QUEUED": 1}), F.lit(0))
    weight = F.when(urgency > 0, lc.lookup(kind, {"EXPORT": 3, "ANALYZE": 2, "DOWNLOAD": 1})).otherwise(0)
    rest = [c for c in tasks.columns if c != "job_id"]
    best = F.max(
        F.struct(urgency.alias("u"), weight.alias("w"), F.col("task_id"), F.struct(*rest).alias("task"))
    ).alias("best")
    return tasks.groupBy("job_id").agg(best).select("job_id", "best.task")


def retry_message(task_type: Column, attempts: Column) -> Column:
    again = (F.coalesce(attempts, F.lit(0)).cast("long") + 1).cast("string")
    return F.concat(lc.lookup(task_type, RETRY_MESSAGE), again, F.lit(" is queued"))


def project_status(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Job state, progress, message and time as implied by the job's tasks.

    Failed and canceled jobs, jobs without tasks and jobs whose deciding task ended
    badly keep what is stored; success only ever moves a job forward.
    """
    stored, kind, state = F.col("status"), F.col("task.task_type"), F.col("task.status")
    attempts = F.coalesce(F.col("task.attempt_count"), F.lit(0))
    at_review = stored.isin("READY_FOR_REVIEW", "EXPORTING_CLIP", "COMPLETED")
    downloaded = stored.isin("QUEUED_FOR_PROCESSING", *lc.ANALYZE_STAGES) | at_review
    finer = ((kind == "ANALYZE") & stored.isin(*lc.ANALYZE_STAGES)) | (
        (kind == "DOWNLOAD") & (stored == "DOWNLOADING")
    )
    verdict = (
        F.when(F.col("task").isNull() | stored.isin("CANCELED", "FAILED"), "keep")
        .when(state == "QUEUED", "queued")
        .when((state == "RUNNING") & finer, "touch")
        .when(state.isin("CLAIMED", "RUNNING"), "claimed")
        .when((state == "SUCCEEDED") & (kind == "DOWNLOAD") & ~downloaded, "to_analysis")
        .when((state == "SUCCEEDED") & (kind == "ANALYZE") & ~at_review, "ready")
        .when(
            (state == "SUCCEEDED") & (kind == "EXPORT") & ~stored.isin("READY_FOR_REVIEW", "COMPLETED"), "ready"
        )
        .otherwise("keep")
    )
    v = F.col("verdict")
    new_status = lc.pick(v, {
        "queued": lc.lookup(kind, QUEUED_AS), "claimed": lc.lookup(kind, CLAIMED_AS),
        "to_analysis": QUEUED_AS["ANALYZE"], "ready": "READY_FOR_REVIEW",
    }).otherwise(stored)
    queued_message = F.when(
        (attempts > 0) & F.col("task.failure_message").isNotNull(), retry_message(kind, attempts)
    ).otherwise(lc.lookup(kind, QUEUED_MESSAGE))
    message = lc.pick(v, {
        "queued": queued_message, "claimed": lc.lookup(kind, CLAIMED_MESSAGE),
        "to_analysis": QUEUED_MESSAGE["ANALYZE"], "ready": READY_MESSAGE,
    }).otherwise(F.col("progress_message"))
    when = F.coalesce(
        *[F.col(f"task.{c}") for c in ("finished_at", "last_heartbeat_at", "claimed_at", "updated_at", "created_at")],
        F.col("updated_at"),
    )
    quiet = v.isin("keep", "touch")
    return (
        jobs.join(deciding_task(tasks).hint("merge"), "job_id", "left")
        .withColumn("verdict", verdict)
        .select(
            "job_id", stored.alias("stored_status"), new_status.alias("projected_status"),
            F.when(quiet, F.col("progress_percent")).otherwise(lc.status_progress(new_status)).alias("progress_percent"),
            message.alias("progress_message"),
            F.when(v == "keep", F.col("updated_at")).otherwise(when).alias("updated_at"),
            F.when(v.isin("queued", "to_analysis", "ready"), None).otherwise(F.col("current_worker_id"))
            .alias("current_worker_id"),
            F.when(v == "ready", when).otherwise(F.col("finished_at")).alias("finished_at"),
        )
    )


def _micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def _heard_before(as_of: Column, task_type: Column, timeout_sec: dict[str, int]) -> Column:
    """The time, in microseconds, before which a heartbeat is too old."""
    return _micros(as_of) - lc.lookup(task_type, timeout_sec).cast("long") * 1_000_000


def stale_tasks(tasks: DataFrame, as_of: Column, timeout_sec: dict[str, int] = lc.STALE_AFTER_SEC) -> DataFrame:
    """Claimed or running tasks not heard of for longer than their type allows."""
    beat = F.col("last_heartbeat_at")
    return tasks.where(
        F.col("status").isin("CLAIMED", "RUNNING") & beat.isNotNull()
        & (_micros(beat) < _heard_before(as_of, F.col("task_type"), timeout_sec))
    )


def failure_policy(failing: DataFrame, as_of: Column, summary: Column) -> DataFrame:
    """What becomes of failing tasks: queued again later, or given up."""
    kind = F.col("task_type")
    budget = F.when(F.col("max_attempts") >= 1, F.col("max_attempts")).otherwise(lc.lookup(kind, lc.MAX_ATTEMPTS))
    attempts = F.coalesce(F.col("attempt_count"), F.lit(0)).cast("long")
    spent = attempts >= budget
    wait = lc.retry_backoff_sec(kind, attempts)
    return failing.select(
        "task_id", "job_id", "task_type", attempts.alias("attempt_count"),
        F.when(spent, "DEAD_LETTERED").otherwise("QUEUED").alias("next_status"),
        F.when(~spent, F.timestamp_micros(_micros(as_of) + wait * 1_000_000)).alias("next_available_at"),
        F.when(spent, F.concat(summary, F.lit(" (retry budget exhausted after "), attempts.cast("string"),
                               F.lit(" attempts)"))).otherwise(retry_message(kind, attempts)).alias("note"),
    )


def ready_queue(tasks: DataFrame, jobs: DataFrame, as_of: Column, sources: DataFrame | None = None) -> DataFrame:
    """Queued tasks that may start, with their place in the line of their type.

    Analysis also needs a source: a job listed in ``sources``, or by default one with a
    stored path.  Places are counted per hour of availability, and for
    tasks without one per range of ids, so a long line is numbered by many tasks.
    """
    at = F.col("available_at")
    waiting = tasks.where(F.col("status") == "QUEUED").where(at.isNull() | (at <= as_of))
    usable = jobs.where(F.trim(F.col("storage_video_path")) != "") if sources is None else sources
    analysis = waiting.where("task_type = 'ANALYZE'").join(usable.select("job_id"), "job_id", "left_semi")
    ready = waiting.where("task_type <> 'ANALYZE'").unionByName(analysis)
    hour = F.floor(F.unix_seconds(at.cast("timestamp")) / 3600).cast("long")
    unset = F.lit(2**40).cast("long") + F.floor(F.col("task_id") / 100_000).cast("long")
    placed = ordinal(ready, ["task_type"], F.coalesce(hour, unset), [at.asc_nulls_last(), F.col("task_id")], "place")
    return placed.select("task_type", "task_id", "job_id", (F.col("place") + 1).alias("place"))


def pending_exports(candidates: DataFrame, jobs: DataFrame, status: str) -> DataFrame:
    free = jobs.where(F.col("current_worker_id").isNull()).select("job_id", "updated_at")
    return (
        candidates.where(F.col("export_status") == status).join(free, "job_id").orderBy("updated_at", "candidate_id")
    )


def worker_diagnostics(tasks: DataFrame, as_of: Column, timeout_sec: dict[str, int] = lc.STALE_AFTER_SEC) -> DataFrame:
    """Queued, claimed, running and stale work per worker role; idle roles show zeros."""
    spark = tasks.sparkSession
    state, kind = F.col("status"), F.col("task_type")
    active = state.isin("CLAIMED", "RUNNING")
    beat = F.when(active, F.col("last_heartbeat_at"))
    late = _micros(beat) < _heard_before(as_of, kind, timeout_sec)
    open_tasks = tasks.where(state.isin("QUEUED", "CLAIMED", "RUNNING"))
    per_type = open_tasks.groupBy(lc.role_of(kind).alias("role"), "task_type").agg(
        F.count_if(state == "QUEUED").alias("queued"), F.count_if(state == "CLAIMED").alias("claimed"),
        F.count_if(state == "RUNNING").alias("running"), F.count_if(late).alias("stale"),
        F.min(beat).alias("oldest_heartbeat_at"),
    )

    def as_map(value: Column, name: str) -> Column:
        entries = F.array_sort(F.collect_list(F.when(value > 0, F.struct("task_type", value.alias("n")))))
        return F.map_from_entries(entries).alias(name)

    per_role = per_type.groupBy("role").agg(
        *[F.sum(c).alias(c) for c in ("queued", "claimed", "running", "stale")],
        F.min("oldest_heartbeat_at").alias("oldest_heartbeat_at"),
        as_map(F.col("queued"), "queued_by_type"),
        as_map(F.col("claimed") + F.col("running"), "active_by_type"),
    )
    roles = spark.createDataFrame([(r,) for r in lc.ROLES], "role string")
    zero = F.lit(0).cast("long")
    return roles.join(per_role, "role", "left").select(
        "role", *[F.coalesce(c, zero).alias(c) for c in ("queued", "claimed", "running", "stale")],
        "oldest_heartbeat_at", "queued_by_type", "active_by_type",
    )


def gauges(jobs: DataFrame) -> DataFrame:
    """Queue depth and active work, one row per gauge."""
    s = F.col("status")
    counts = {
        "queue_depth.download": s == "QUEUED_FOR_DOWNLOAD",
        "queue_depth.processing": s == "QUEUED_FOR_PROCESSING",
        "jobs_active.processing": s.isin(*lc.PROCESSING_NOW),
        "jobs_active.export": s == "EXPORTING_CLIP",
    }
    one = jobs.agg(*[F.count_if(c).alias(n.replace(".", "_")) for n, c in counts.items()])
    pairs = ", ".join(f"'{n}', {n.replace('.', '_')}" for n in counts)
    return one.selectExpr(f"stack({len(counts)}, {pairs}) as (gauge, value)")


def review_complete(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Jobs in review with nothing pending and nothing approved but not exported."""
    state = F.col("moderation_status")
    open_work = candidates.groupBy("job_id").agg(
        F.max((state == "PENDING") | ((state == "APPROVED") & (F.col("export_status") != "COMPLETED"))).alias("open")
    )
    return (
        jobs.where("status = 'READY_FOR_REVIEW'").join(open_work, "job_id", "left")
        .where(~F.coalesce("open", F.lit(False))).drop("open")
    )


def apply_moderation(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """The last decision per candidate replaces its stored moderation state."""
    last = decisions.groupBy("candidate_id").agg(
        F.max(F.struct("decided_at", "decision_id", "decision")).alias("d")
    ).select("candidate_id", F.col("d.decision").alias("decision"))
    return candidates.join(last, "candidate_id", "left").withColumn(
        "moderation_status", F.coalesce("decision", "moderation_status")
    ).drop("decision")


def candidate_order(candidates: DataFrame) -> DataFrame:
    """Best first within a job; a range-partitioned sort, so large jobs span tasks."""
    return candidates.orderBy("job_id", F.desc("score"), "start_sec", "candidate_id")


def candidate_page(candidates: DataFrame, page: int, size: int = 20) -> DataFrame:
    """One page per job; a page past the end gives the last one.

    Only the first ``page * size`` rows of a job can matter, so the ranking is cut to
    them before rows are shuffled.
    """
    if not 1 <= size <= 100:
        raise ValueError("page size must be between 1 and 100")
    page = max(page, 1)
    order = Window.partitionBy("job_id").orderBy(F.desc("score"), "start_sec", "candidate_id")
    top = candidates.withColumn("n", F.row_number().over(order)).where(F.col("n") <= page * size)
    totals = candidates.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_items"))
    pages = F.ceil(F.col("total_items") / size).cast("long")
    shown = F.least(F.lit(page).cast("long"), F.col("total_pages"))
    return (
        top.join(totals.withColumn("total_pages", pages).withColumn("page", shown), "job_id")
        .where((F.col("n") > (F.col("page") - 1) * size) & (F.col("n") <= F.col("page") * size))
        .withColumn("has_previous", F.col("page") > 1)
        .withColumn("has_next", F.col("page") < F.col("total_pages"))
    )


def _ended_before(cutoff: Column) -> Column:
    return F.coalesce("finished_at", "updated_at") < cutoff


def expired_sources(jobs: DataFrame, cutoff: Column) -> DataFrame:
    return jobs.where(
        F.col("status").isin("COMPLETED", "FAILED") & (F.trim("storage_video_path") != "") & _ended_before(cutoff)
    )


def expired_artifacts(jobs: DataFrame, candidates: DataFrame, cutoff: Column) -> DataFrame:
    ended = jobs.where((F.col("status") == "COMPLETED") & _ended_before(cutoff)).select("job_id")
    exported = candidates.where((F.col("export_status") == "COMPLETED") & (F.trim("exported_clip_path") != ""))
    return exported.join(ended, "job_id")


# What a retention event says where the file was there, and where it was gone already.
CLEANED_MESSAGE = {
    "SOURCE_CLEANED": ("Retention cleanup removed the source video after the configured retention window",
                       "Retention cleanup found the source video already missing and cleared the stored reference"),
    "ARTIFACT_CLEANED": ("Retention cleanup removed the export artifact for candidate {id}",
                         "Retention cleanup found the export artifact already missing for candidate {id} and cleared the stored reference"),
}


def retention_events(
    jobs: DataFrame, candidates: DataFrame, source_cutoff: Column, artifact_cutoff: Column, manifest: DataFrame
) -> DataFrame:
    """The event rows a clean-up writes; ``manifest(path)`` lists what still exists."""
    sources = expired_sources(jobs, source_cutoff).select(
        "job_id", F.lit(None).cast("long").alias("candidate_id"), F.col("storage_video_path").alias("path"),
        F.lit("SOURCE_CLEANED").alias("event_type"),
    )
    artifacts = expired_artifacts(jobs, candidates, artifact_cutoff).select(
        "job_id", "candidate_id", F.col("exported_clip_path").alias("path"), F.lit("ARTIFACT_CLEANED").alias("event_type")
    )
    known = manifest.select("path").distinct().withColumn("existed", F.lit(True))
    which = F.col("candidate_id").cast("string")
    source, there = F.col("event_type") == "SOURCE_CLEANED", F.col("existed")
    own = F.when(there, CLEANED_MESSAGE["SOURCE_CLEANED"][0]).otherwise(CLEANED_MESSAGE["SOURCE_CLEANED"][1])
    clip = F.when(there, CLEANED_MESSAGE["ARTIFACT_CLEANED"][0]).otherwise(CLEANED_MESSAGE["ARTIFACT_CLEANED"][1])
    message = F.when(source, own).otherwise(F.replace(clip, F.lit("{id}"), which))
    return (
        sources.unionByName(artifacts).join(known, "path", "left")
        .withColumn("existed", F.coalesce("existed", F.lit(False)))
        .withColumn("message", message)
    )


def exported_paths(candidates: DataFrame) -> DataFrame:
    return candidates.where((F.col("export_status") == "COMPLETED") & F.col("exported_clip_path").isNotNull())


def without_jobs(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """What remains of a child table once jobs are deleted."""
    return rows.join(deleted.select("job_id"), "job_id", "left_anti")


def jobs_summary(jobs: DataFrame) -> DataFrame:
    """Totals for the overview; a job ready for review counts as active and as ready."""
    s = F.col("status")
    active = ~s.isin(*lc.FINISHED) & s.isin(*lc.PROGRESS)
    can = lc.allowed_actions(s)
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"),
        F.count_if(s == "READY_FOR_REVIEW").alias("ready"), F.count_if(s.isin(*lc.FINISHED)).alias("finished"),
        F.count_if(can["can_delete"]).alias("deletable"), F.count_if(can["can_complete"]).alias("completable"),
        F.count_if(can["can_force_fail"]).alias("running"),
    )


def admit_callbacks(callbacks: DataFrame, jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the first check a worker's callback fails, or null."""
    j = jobs.select("job_id", F.col("processing_version").alias("j_version"), F.col("current_worker_id").alias("j_worker"))
    e = executions.select(
        "execution_id", F.col("job_id").alias("e_job"), F.col("processing_version").alias("e_version"),
        F.col("worker_id").alias("e_worker"), F.col("task_type").alias("e_type"),
        F.col("candidate_id").alias("e_candidate"), F.col("status").alias("e_status"),
    )
    c = F.col
    reason = (
        F.when(c("j_version").isNull() | (c("j_version") != c("processing_version")), "stale version")
        .when(c("j_worker").isNotNull() & (c("j_worker") != c("worker_id")), "lease not owned")
        .when(c("e_job").isNull(), "unknown execution")
        .when(c("e_job") != c("job_id"), "execution of another job")
        .when(c("e_version") != c("processing_version"), "stale execution version")
        .when(c("e_worker") != c("worker_id"), "execution of another worker")
        .when(c("expected_type").isNotNull() & (c("e_type") != c("expected_type")), "task type mismatch")
        .when(c("expected_candidate").isNotNull() & ~c("e_candidate").eqNullSafe(c("expected_candidate")),
              "execution of another candidate")
        .when(~c("e_status").isin("CLAIMED", "RUNNING"), "execution not active")
    )
    return (
        callbacks.join(j, "job_id", "left").join(e, "execution_id", "left")
        .withColumn("reject_reason", reason)
        .select(*callbacks.columns, "reject_reason")
    )
