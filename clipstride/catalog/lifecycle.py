"""Jobs, tasks, executions, candidates and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.catalog import query
from clipstride.catalog.inputs import Tables, add_view
from clipstride.functions import lifecycle as lc
from clipstride.operators import events as ev
from clipstride.operators import lifecycle as op

AS_OF, SOURCE_CUTOFF, ARTIFACT_CUTOFF = "1998-06-01", "1998-05-25", "1998-05-02"
SQL_AS_OF = "timestamp '1998-06-01'"
# The given tables move in days, so the timeouts are scaled to days.
STALE_DAYS = {"DOWNLOAD": 15 * 86400, "ANALYZE": 20 * 86400, "EXPORT": 2 * 86400}
SQL_SOURCE_CUTOFF, SQL_ARTIFACT_CUTOFF = "timestamp '1998-05-25'", "timestamp '1998-05-02'"


def when(date: str):
    return F.lit(date).cast("timestamp_ntz")


def day(name: str, alias: str | None = None):
    return F.date_format(name, "yyyy-MM-dd HH:mm").alias(alias or name)


def sql_day(name: str, alias: str | None = None) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M') as {alias or name}"


def sql_case(key: str, values: dict) -> str:
    arms = " ".join(f"when '{k}' then " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in values.items())
    return f"(case {key} {arms} end)"


def sql_in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


add_view("last_task", "select * from tasks qualify row_number() over (partition by job_id order by task_id desc) = 1")
add_view("last_run", "select * from executions qualify row_number() over (partition by job_id order by execution_id desc) = 1")


@query("latest_task_per_job", f"""
    select job_id, task_id, task_type, status, {sql_day('created_at')} from last_task""")
def latest_task_per_job(t: Tables) -> DataFrame:
    return op.latest_per_job(t.tasks.select("job_id", "task_id", "task_type", "status", "created_at"), "task_id").select(
        "job_id", "task_id", "task_type", "status", day("created_at")
    )


@query("job_list", f"""
    select j.job_id, j.status, {sql_day('j.created_at', 'created_at')}, e.execution_id, e.worker_id,
           e.status as execution_status, k.task_id, k.task_type, k.status as task_status
    from jobs j left join last_run e on e.job_id = j.job_id left join last_task k on k.job_id = j.job_id""")
def job_list(t: Tables) -> DataFrame:
    return op.job_list(t.jobs, t.executions, t.tasks).select(
        "job_id", "status", day("created_at"), "execution_id", "worker_id", "execution_status", "task_id",
        "task_type", "task_status",
    )


@query("children_in_order", """
    select 'segment' as child, job_id, segment_id as id, start_sec as place from segments
    union all select 'task', job_id, task_id, epoch(created_at)::double from tasks
    union all select 'execution', job_id, execution_id, epoch(claimed_at)::double from executions
    union all select 'event', job_id, event_id, us / 1000000e0 from job_events""")
def children_in_order(t: Tables) -> DataFrame:
    def child(rows: DataFrame, name: str, key: str, place) -> DataFrame:
        return rows.select(F.lit(name).alias("child"), "job_id", F.col(key).alias("id"), place.alias("place"))

    def at(column: str):
        return F.unix_seconds(F.col(column).cast("timestamp")).cast("double")

    rows = child(t.segments, "segment", "segment_id", F.col("start_sec"))
    rows = rows.unionByName(child(t.tasks, "task", "task_id", at("created_at")))
    rows = rows.unionByName(child(t.executions, "execution", "execution_id", at("claimed_at")))
    rows = rows.unionByName(child(t.job_events, "event", "event_id", F.col("us") / 1000000.0))
    return op.children_in_order(rows, "child", "place", "id")


_W, _A = "('READY_FOR_REVIEW', 'EXPORTING_CLIP', 'COMPLETED')", sql_in(lc.ANALYZE_STAGES)
add_view("deciding", f"""
    select * from (select *, case status when 'RUNNING' then 3 when 'CLAIMED' then 2 when 'QUEUED' then 1 else 0 end as u,
                   case task_type when 'EXPORT' then 3 when 'ANALYZE' then 2 else 1 end as w from tasks)
    qualify row_number() over (partition by job_id order by u desc, case when u > 0 then w else 0 end desc, task_id desc) = 1""")
add_view("verdicts", f"""
    select j.*, k.task_type as kind, k.attempt_count, k.failure_message,
           coalesce(k.finished_at, k.last_heartbeat_at, k.claimed_at, k.updated_at, k.created_at, j.updated_at) as at_time,
           case when k.job_id is null or j.status in ('CANCELED', 'FAILED') then 'keep'
                when k.status = 'QUEUED' then 'queued'
                when k.status = 'RUNNING' and ((k.task_type = 'ANALYZE' and j.status in {_A})
                  or (k.task_type = 'DOWNLOAD' and j.status = 'DOWNLOADING')) then 'touch'
                when k.status in ('CLAIMED', 'RUNNING') then 'claimed'
                when k.status = 'SUCCEEDED' and k.task_type = 'DOWNLOAD' and j.status <> 'QUEUED_FOR_PROCESSING'
                  and j.status not in {_A} and j.status not in {_W} then 'to_analysis'
                when k.status = 'SUCCEEDED' and k.task_type = 'ANALYZE' and j.status not in {_W} then 'ready'
                when k.status = 'SUCCEEDED' and k.task_type = 'EXPORT'
                  and j.status not in ('READY_FOR_REVIEW', 'COMPLETED') then 'ready'
                else 'keep' end as verdict
    from jobs j left join deciding k on k.job_id = j.job_id""")
add_view("projected", f"""
    select *, case verdict when 'queued' then {sql_case('kind', op.QUEUED_AS)}
                when 'claimed' then {sql_case('kind', op.CLAIMED_AS)} when 'to_analysis' then 'QUEUED_FOR_PROCESSING'
                when 'ready' then 'READY_FOR_REVIEW' else status end as projected_status
    from verdicts""")


@query("job_status_projection", f"""
    select job_id, status as stored_status, projected_status,
           case when verdict in ('keep', 'touch') then progress_percent
                else {sql_case('projected_status', lc.PROGRESS)} end::bigint as progress_percent,
           case verdict when 'queued' then case when attempt_count > 0 and failure_message is not null
                  then {sql_case('kind', op.RETRY_MESSAGE)} || (attempt_count + 1) || ' is queued'
                  else {sql_case('kind', op.QUEUED_MESSAGE)} end
                when 'claimed' then {sql_case('kind', op.CLAIMED_MESSAGE)}
                when 'to_analysis' then '{op.QUEUED_MESSAGE["ANALYZE"]}'
                when 'ready' then '{op.READY_MESSAGE}' else progress_message end as progress_message,
           {sql_day("case when verdict = 'keep' then updated_at else at_time end", 'updated_at')},
           case when verdict not in ('queued', 'to_analysis', 'ready') then current_worker_id end as current_worker_id,
           {sql_day("case when verdict = 'ready' then at_time else finished_at end", 'finished_at')}
    from projected""")
def job_status_projection(t: Tables) -> DataFrame:
    return op.project_status(t.jobs, t.tasks).select(
        "job_id", "stored_status", "projected_status", "progress_percent", "progress_message", day("updated_at"),
        "current_worker_id", day("finished_at"),
    )


add_view("stale", f"""
    select * from tasks where status in ('CLAIMED', 'RUNNING') and last_heartbeat_at is not null
      and last_heartbeat_at < {SQL_AS_OF} - to_seconds({sql_case('task_type', STALE_DAYS)})""")


@query("stale_tasks", f"select task_id, job_id, task_type, {sql_day('last_heartbeat_at')} from stale")
def stale_tasks(t: Tables) -> DataFrame:
    return op.stale_tasks(t.tasks, when(AS_OF), STALE_DAYS).select("task_id", "job_id", "task_type", day("last_heartbeat_at"))


@query("failure_policy", f"""
    select task_id, job_id, task_type, attempt_count,
           case when attempt_count >= max_attempts then 'DEAD_LETTERED' else 'QUEUED' end as next_status,
           case when attempt_count < max_attempts then epoch({SQL_AS_OF})::bigint + least({sql_case('task_type', lc.MAX_BACKOFF_SEC)},
             {sql_case('task_type', lc.INITIAL_BACKOFF_SEC)} * 2 ** (greatest(attempt_count, 1) - 1))::bigint end
             as next_available_sec,
           case when attempt_count >= max_attempts
             then 'no heartbeat (retry budget exhausted after ' || attempt_count || ' attempts)'
             else {sql_case('task_type', op.RETRY_MESSAGE)} || (attempt_count + 1) || ' is queued' end as note
    from (select * from stale union all select * from tasks where status = 'FAILED')""")
def failure_policy(t: Tables) -> DataFrame:
    failing = op.stale_tasks(t.tasks, when(AS_OF), STALE_DAYS).unionByName(t.tasks.where("status = 'FAILED'"))
    return op.failure_policy(failing, when(AS_OF), F.lit("no heartbeat")).select(
        "task_id", "job_id", "task_type", "attempt_count", "next_status",
        F.unix_seconds("next_available_at").alias("next_available_sec"), "note",
    )


@query("ready_queue", f"""
    select task_type, task_id, job_id,
           row_number() over (partition by task_type order by available_at asc nulls last, task_id) as place
    from tasks where status = 'QUEUED' and (available_at is null or available_at <= {SQL_AS_OF})
      and (task_type <> 'ANALYZE' or job_id in (select job_id from jobs where trim(storage_video_path) <> ''))""")
def ready_queue(t: Tables) -> DataFrame:
    return op.ready_queue(t.tasks, t.jobs, when(AS_OF))


@query("worker_diagnostics", f"""
    select r.role, coalesce(queued, 0) as queued, coalesce(claimed, 0) as claimed, coalesce(running, 0) as running,
           coalesce(stale, 0) as stale, {sql_day('oldest', 'oldest_heartbeat_at')},
           case when queued > 0 then task_type || '=' || queued else '' end as queued_by_type,
           case when claimed + running > 0 then task_type || '=' || (claimed + running) else '' end as active_by_type
    from (values ('download', 'DOWNLOAD'), ('processing', 'ANALYZE'), ('export', 'EXPORT')) r(role, kind)
    left join (select task_type, count(*) filter (status = 'QUEUED') as queued,
                 count(*) filter (status = 'CLAIMED') as claimed, count(*) filter (status = 'RUNNING') as running,
                 count(*) filter (status <> 'QUEUED' and last_heartbeat_at < {SQL_AS_OF}
                   - to_seconds({sql_case('task_type', STALE_DAYS)})) as stale,
                 min(last_heartbeat_at) filter (status <> 'QUEUED') as oldest
               from tasks where status in ('QUEUED', 'CLAIMED', 'RUNNING') group by task_type) k on k.task_type = r.kind""")
def worker_diagnostics(t: Tables) -> DataFrame:
    def text(name: str):
        entries = F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        return F.coalesce(F.array_join(entries, ","), F.lit("")).alias(name)

    return op.worker_diagnostics(t.tasks, when(AS_OF), STALE_DAYS).select(
        "role", "queued", "claimed", "running", "stale", day("oldest_heartbeat_at"), text("queued_by_type"),
        text("active_by_type"),
    )


@query("queue_gauges", f"""
    select unnest(['queue_depth.download', 'queue_depth.processing', 'jobs_active.processing', 'jobs_active.export']) as gauge,
           unnest([count(*) filter (status = 'QUEUED_FOR_DOWNLOAD'), count(*) filter (status = 'QUEUED_FOR_PROCESSING'),
                   count(*) filter (status in {sql_in(lc.PROCESSING_NOW)}), count(*) filter (status = 'EXPORTING_CLIP')]) as value
    from jobs""")
def queue_gauges(t: Tables) -> DataFrame:
    return op.gauges(t.jobs)


@query("pending_exports", f"""
    select candidate_id, c.job_id, {sql_day('j.updated_at', 'updated_at')}
    from candidates c join jobs j on j.job_id = c.job_id
    where export_status = 'NOT_REQUESTED' and current_worker_id is null""")
def pending_exports(t: Tables) -> DataFrame:
    return op.pending_exports(t.candidates, t.jobs, "NOT_REQUESTED").select("candidate_id", "job_id", day("updated_at"))


@query("review_rollup", """
    select job_id from jobs where status = 'READY_FOR_REVIEW' and job_id not in (
      select job_id from candidates where moderation_status = 'PENDING'
        or (moderation_status = 'APPROVED' and export_status <> 'COMPLETED'))""")
def review_rollup(t: Tables) -> DataFrame:
    return op.review_complete(t.jobs, t.candidates).select("job_id")


# Decisions come from other rows of the same job: each row decides on its successor too.
add_view("decisions", """
    select job_id * 100 + 1 + n % 3 as candidate_id, candidate_id as decision_id, decided_at, moderation_status as decision
    from candidates where moderation_status <> 'PENDING'""")


@query("apply_moderation", """
    select c.candidate_id, c.job_id, coalesce(d.decision, c.moderation_status) as moderation_status
    from candidates c left join (
      select * from decisions qualify row_number() over (partition by candidate_id order by decided_at desc, decision_id desc) = 1) d
    on d.candidate_id = c.candidate_id""")
def apply_moderation(t: Tables) -> DataFrame:
    decisions = t.candidates.where("moderation_status <> 'PENDING'").select(
        (F.col("job_id") * 100 + 1 + F.col("n") % 3).alias("candidate_id"),
        F.col("candidate_id").alias("decision_id"), "decided_at", F.col("moderation_status").alias("decision"),
    )
    return op.apply_moderation(t.candidates.select("candidate_id", "job_id", "moderation_status"), decisions)


@query("candidate_order", "select job_id, candidate_id, score, start_sec from candidates")
def candidate_order(t: Tables) -> DataFrame:
    return op.candidate_order(t.candidates.select("job_id", "candidate_id", "score", "start_sec"))


@query("candidate_page", """
    select job_id, candidate_id, score, n, total_items, total_pages, page, page > 1 as has_previous, page < total_pages as has_next
    from (select *, least(2, total_pages) as page
          from (select *, ceil(total_items / 3e0)::bigint as total_pages
                from (select *, row_number() over (partition by job_id order by score desc, start_sec, candidate_id) as n,
                             count(*) over (partition by job_id) as total_items from candidates)))
    where n > (page - 1) * 3 and n <= page * 3""".replace("select *, row_number()", "select * exclude (n), row_number()"))
def candidate_page(t: Tables) -> DataFrame:
    rows = t.candidates.select("job_id", "candidate_id", "score", "start_sec")
    return op.candidate_page(rows, page=2, size=3).select(
        "job_id", "candidate_id", "score", F.col("n").cast("long").alias("n"), "total_items", "total_pages", "page",
        "has_previous", "has_next",
    )


add_view("old_sources", f"""
    select * from jobs where status in ('COMPLETED', 'FAILED') and trim(storage_video_path) <> ''
      and coalesce(finished_at, updated_at) < {SQL_SOURCE_CUTOFF}""")
add_view("old_artifacts", f"""
    select c.* from candidates c join jobs j on j.job_id = c.job_id
    where j.status = 'COMPLETED' and coalesce(j.finished_at, j.updated_at) < {SQL_ARTIFACT_CUTOFF}
      and c.export_status = 'COMPLETED' and trim(c.exported_clip_path) <> ''""")


@query("expired_sources", "select job_id, status, storage_video_path from old_sources")
def expired_sources(t: Tables) -> DataFrame:
    return op.expired_sources(t.jobs, when(SOURCE_CUTOFF)).select("job_id", "status", "storage_video_path")


@query("expired_artifacts", "select job_id, candidate_id, exported_clip_path from old_artifacts")
def expired_artifacts(t: Tables) -> DataFrame:
    return op.expired_artifacts(t.jobs, t.candidates, when(ARTIFACT_CUTOFF)).select(
        "job_id", "candidate_id", "exported_clip_path"
    )


# The messages are fixed values.
@query("retention_events", """
    select job_id, candidate_id, path, event_type, existed,
           case when event_type = 'SOURCE_CLEANED' and existed
                  then 'Retention cleanup removed the source video after the configured retention window'
                when event_type = 'SOURCE_CLEANED'
                  then 'Retention cleanup found the source video already missing and cleared the stored reference'
                when existed then 'Retention cleanup removed the export artifact for candidate ' || candidate_id
                else 'Retention cleanup found the export artifact already missing for candidate ' || candidate_id
                     || ' and cleared the stored reference' end as message
    from (select *, path in (select exported_clip_path from candidates where export_status = 'COMPLETED' and n % 2 = 1
                             union all select storage_video_path from jobs where progress_percent > 100
                               and storage_video_path is not null) as existed
          from (select job_id, null::bigint as candidate_id, storage_video_path as path, 'SOURCE_CLEANED' as event_type from old_sources
                union all select job_id, candidate_id, exported_clip_path, 'ARTIFACT_CLEANED' from old_artifacts))""")
def retention_events(t: Tables) -> DataFrame:
    manifest = t.candidates.where("export_status = 'COMPLETED' and n % 2 = 1").select(
        F.col("exported_clip_path").alias("path")
    ).unionByName(
        t.jobs.where("progress_percent > 100 and storage_video_path is not null").select(
            F.col("storage_video_path").alias("path")
        )
    )
    return op.retention_events(t.jobs, t.candidates, when(SOURCE_CUTOFF), when(ARTIFACT_CUTOFF), manifest).select(
        "job_id", "candidate_id", "path", "event_type", "existed", "message"
    )


@query("exported_paths", """
    select job_id, candidate_id, exported_clip_path from candidates
    where export_status = 'COMPLETED' and exported_clip_path is not null""")
def exported_paths(t: Tables) -> DataFrame:
    return op.exported_paths(t.candidates).select("job_id", "candidate_id", "exported_clip_path")


@query("cascade_delete", """
    select 'candidates' as child, count(*) as remaining from candidates
      where job_id not in (select job_id from jobs where status in ('CANCELED', 'FAILED'))
    union all select 'tasks', count(*) from tasks
      where job_id not in (select job_id from jobs where status in ('CANCELED', 'FAILED'))
    union all select 'events', count(*) from job_events
      where job_id not in (select job_id from jobs where status in ('CANCELED', 'FAILED'))""")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.jobs.where("status in ('CANCELED', 'FAILED')")
    children = {"candidates": t.candidates, "tasks": t.tasks, "events": t.job_events}
    out = None
    for name, rows in children.items():
        left = op.without_jobs(rows.select("job_id"), gone).agg(F.count(F.lit(1)).alias("remaining"))
        left = left.select(F.lit(name).alias("child"), "remaining")
        out = left if out is None else out.unionByName(left)
    return out


@query("jobs_summary", f"""
    select count(*) as total, count(*) filter (status not in {sql_in(lc.FINISHED)}) as active,
           count(*) filter (status = 'READY_FOR_REVIEW') as ready, count(*) filter (status in {sql_in(lc.FINISHED)}) as finished,
           count(*) filter (status in {sql_in(lc.DELETABLE)}) as deletable,
           count(*) filter (status in {sql_in(lc.COMPLETABLE)}) as completable,
           count(*) filter (status in {sql_in(lc.FORCE_FAILABLE)}) as running
    from jobs""")
def jobs_summary(t: Tables) -> DataFrame:
    return op.jobs_summary(t.jobs)


@query("allowed_actions", f"""
    select job_id, status, status in {sql_in(lc.RETRYABLE)} as can_retry, status in {sql_in(lc.CANCELABLE)} as can_cancel,
           status in {sql_in(lc.FORCE_FAILABLE)} as can_force_fail, status in {sql_in(lc.DELETABLE)} as can_delete,
           status in {sql_in(lc.COMPLETABLE)} as can_complete from jobs""")
def allowed_actions(t: Tables) -> DataFrame:
    return t.jobs.select(
        "job_id", "status", *[c.alias(n) for n, c in lc.allowed_actions(F.col("status")).items()]
    )


@query("status_progress", f"""
    select job_id, status, coalesce({sql_case('status', lc.PROGRESS)}, 0)::bigint as status_percent,
           case when progress_percent >= 0 then least(progress_percent, 100)
                else coalesce({sql_case('status', lc.PROGRESS)}, 0) end::bigint as shown_percent from jobs""")
def status_progress(t: Tables) -> DataFrame:
    return t.jobs.select(
        "job_id", "status", lc.status_progress(F.col("status")).alias("status_percent"),
        lc.shown_progress(F.col("progress_percent"), F.col("status")).alias("shown_percent"),
    )


@query("retry_backoff", f"""
    select task_id, task_type, attempt_count, least({sql_case('task_type', lc.MAX_BACKOFF_SEC)},
             {sql_case('task_type', lc.INITIAL_BACKOFF_SEC)} * 2 ** (greatest(attempt_count, 1) - 1))::bigint as backoff_sec
    from tasks""")
def retry_backoff(t: Tables) -> DataFrame:
    return t.tasks.select(
        "task_id", "task_type", "attempt_count",
        lc.retry_backoff_sec(F.col("task_type"), F.col("attempt_count")).alias("backoff_sec"),
    )


def sql_elapsed(a: str, b: str) -> str:
    s = f"greatest(0, floor(({b} - {a}) / 1000000e0)::bigint)"
    return f"""(case when {a} is null or {b} is null then 'n/a' when {s} < 60 then {s} || 's'
      when {s} >= 3600 then ({s} // 3600) || 'h ' || ({s} % 3600 // 60) || 'm'
      when {s} % 60 > 0 then ({s} // 60) || 'm ' || ({s} % 60) || 's' else ({s} // 60) || 'm' end)"""


_KIND = {"JOB_CREATED": "ingest", "JOB_CLAIMED": "processing", "WORKER_PROGRESS": "system",
         "EXPORT_COMPLETED": "export", "JOB_FAILED": "failure"}
add_view("timeline", f"""
    select *, event_type in {sql_in(lc.IMPORTANT_EVENTS)} or up = 1 or down = 1 as important
    from (select *, lag(event_id) over o as previous_id, lag(event_type) over o as previous_type, lag(us) over o as previous_us,
                 row_number() over o as up, row_number() over (partition by job_id order by us desc, event_id desc) as down
          from job_events window o as (partition by job_id order by us, event_id))""")


@query("event_timeline", f"""
    select job_id, event_id, us, event_type, previous_id, previous_type, {sql_elapsed('previous_us', 'us')} as since_previous,
           important from timeline""")
def event_timeline(t: Tables) -> DataFrame:
    return ev.event_timeline(t.job_events.select("job_id", "event_id", "us", "event_type"))


@query("event_phases", f"""
    select event_id, event_type, {sql_case('event_type', _KIND)} as phase,
           {sql_case('event_type', {
               "JOB_CREATED": "all,important,worker", "JOB_CLAIMED": "all,important,worker",
               "WORKER_PROGRESS": "all,important", "EXPORT_COMPLETED": "all,important,worker",
               "JOB_FAILED": "all,important,worker,errors"})} as categories
    from job_events""")
def event_phases(t: Tables) -> DataFrame:
    phase = lc.event_phase(F.col("event_type"))
    return t.job_events.select(
        "event_id", "event_type", phase.alias("phase"), F.array_join(lc.event_categories(phase), ",").alias("categories")
    )


@query("phase_summary", f"""
    select job_id, phase, case phase when 'ingest' then 1 when 'processing' then 2 when 'moderation' then 3
             when 'export' then 4 else 5 end::bigint as position,
           first(event_type order by us desc, event_id desc) as latest_type, max(us) as latest_us, count(*) as n_events,
           {sql_elapsed('min(us)', 'max(us)')} as elapsed
    from (select *, {sql_case('event_type', _KIND)} as phase from job_events) where phase <> 'system'
    group by job_id, phase""")
def phase_summary(t: Tables) -> DataFrame:
    return ev.phase_summary(t.job_events)


@query("event_previews", f"""
    with totals as (select job_id, count(*) as n_raw, count(*) filter (important) as n_important,
                           {sql_elapsed('min(us)', 'max(us)')} as total_elapsed from timeline group by job_id)
    select p.job_id, list, rank, event_id, event_type,
           greatest(0, case list when 'raw' then n_raw - 6 else n_important - 7 end) as hidden, total_elapsed
    from (select job_id, 'raw' as list, down as rank, event_id, event_type from timeline where down <= 6
          union all
          select job_id, 'important', rank, event_id, event_type
          from (select *, row_number() over (partition by job_id order by us desc, event_id desc) as rank
                from timeline where important) where rank <= 7) p join totals t on t.job_id = p.job_id""")
def event_previews(t: Tables) -> DataFrame:
    return ev.event_previews(t.job_events.select("job_id", "event_id", "us", "event_type"))


@query("progress_compaction", """
    with marks as (
      select *, case when event_type = 'WORKER_PROGRESS'
                  and stage is distinct from lag(case when event_type = 'WORKER_PROGRESS' then stage end)
                    over (partition by job_id, event_type = 'WORKER_PROGRESS' order by us, event_id) then 1 else 0 end as change
      from job_events)
    select event_id, job_id, us, event_type from marks m
    where event_type <> 'WORKER_PROGRESS' or not exists (
      select 1 from marks x where x.job_id = m.job_id and (x.us, x.event_id) > (m.us, m.event_id)
        and (x.change = 1 or x.event_type = 'EXPORT_COMPLETED'))""")
def progress_compaction(t: Tables) -> DataFrame:
    return ev.compact_progress(t.job_events, final=("EXPORT_COMPLETED",)).select(
        "event_id", "job_id", "us", "event_type"
    )


METRICS = {"JOB_CREATED": "jobs_created", "EXPORT_COMPLETED": "jobs_completed", "JOB_CLAIMED": "jobs_completed",
           "JOB_FAILED": "jobs_failed"}


@query("counters", f"""
    select {sql_case('event_type', METRICS)} as metric,
           case event_type when 'JOB_CREATED' then source_type
                when 'JOB_FAILED' then case when k % 2 = 0 then 'worker_failure' else 'operator_force' end else '' end as tag,
           count(*) as value
    from job_events e left join jobs j on j.job_id = e.job_id where event_type <> 'WORKER_PROGRESS' group by 1, 2""")
def counters(t: Tables) -> DataFrame:
    rows = t.job_events.join(t.jobs.select("job_id", "source_type"), "job_id", "left")
    tag = (
        F.when(F.col("event_type") == "JOB_CREATED", F.col("source_type"))
        .when((F.col("event_type") == "JOB_FAILED") & (F.col("k") % 2 == 0), "worker_failure")
        .when(F.col("event_type") == "JOB_FAILED", "operator_force").otherwise("")
    )
    return ev.counters(rows, METRICS, tag)


add_view("callbacks", """
    select event_id, user_id * 7 as job_id, user_id * 700 + 8 + event_id % 3 as execution_id,
           'w' || (event_id % 7) as worker_id, 1 + event_id % 3 as processing_version,
           case event_id % 4 when 0 then null when 1 then 'DOWNLOAD' when 2 then 'ANALYZE' else 'EXPORT' end as expected_type,
           case when event_id % 5 = 0 then user_id * 700 + 1 + event_id % 3 end as expected_candidate
    from events""")


def callback_rows(events: DataFrame) -> DataFrame:
    """Callbacks with claims that are right only sometimes, from the event table."""
    e, u = F.col("event_id"), F.col("user_id")
    return events.select(
        e, (u * 7).alias("job_id"), (u * 700 + 8 + e % 3).alias("execution_id"),
        F.concat(F.lit("w"), (e % 7).cast("string")).alias("worker_id"), (1 + e % 3).alias("processing_version"),
        F.when(e % 4 == 1, "DOWNLOAD").when(e % 4 == 2, "ANALYZE").when(e % 4 == 3, "EXPORT").alias("expected_type"),
        F.when(e % 5 == 0, u * 700 + 1 + e % 3).alias("expected_candidate"),
    )


@query("callback_admission", """
    select c.event_id,
      case when j.processing_version is null or j.processing_version <> c.processing_version then 'stale version'
           when j.current_worker_id <> c.worker_id then 'lease not owned'
           when e.execution_id is null then 'unknown execution'
           when e.job_id <> c.job_id then 'execution of another job'
           when e.processing_version <> c.processing_version then 'stale execution version'
           when e.worker_id <> c.worker_id then 'execution of another worker'
           when e.task_type <> c.expected_type then 'task type mismatch'
           when c.expected_candidate is not null and e.candidate_id is distinct from c.expected_candidate
             then 'execution of another candidate'
           when e.status not in ('CLAIMED', 'RUNNING') then 'execution not active' end as reject_reason
    from callbacks c left join jobs j on j.job_id = c.job_id left join executions e on e.execution_id = c.execution_id""")
def callback_admission(t: Tables) -> DataFrame:
    return op.admit_callbacks(callback_rows(t.table("events")), t.jobs, t.executions).select("event_id", "reject_reason")


# The event table is sparse, so alert windows are hours instead of minutes.
add_view("hour_slots", """
    select *, unnest(range(us // 3600000000 - 14, us // 3600000000 + 1)) as slot from job_events""")


@query("failure_rate_windows", """
    select slot as window_hour, completed, failed, failed / greatest(completed + failed, 1)::double as rate,
           failed / greatest(completed + failed, 1)::double > 0.2 as alert
    from (select slot, count(*) filter (event_type = 'EXPORT_COMPLETED') as completed,
                 count(*) filter (event_type = 'JOB_FAILED') as failed from hour_slots
          where event_type in ('EXPORT_COMPLETED', 'JOB_FAILED') group by slot)""")
def failure_rate_windows(t: Tables) -> DataFrame:
    rows = t.job_events.where("event_type in ('EXPORT_COMPLETED', 'JOB_FAILED')").select(
        F.timestamp_micros("us").alias("ts"),
        F.when(F.col("event_type") == "JOB_FAILED", "failed").otherwise("completed").alias("outcome"),
    )
    found = ev.failure_rate(rows, "15 hours", "1 hour")
    return found.select(_hour(), "completed", "failed", "rate", "alert")


def _hour():
    return F.floor(F.unix_seconds("window_start") / 3600).cast("long").alias("window_hour")


@query("backlog_windows", """
    select slot as window_hour, queue, least_depth, least_depth > 10 as alert
    from (select slot, stage as queue, min(k) as least_depth
          from (select *, unnest(range(us // 3600000000 - 4, us // 3600000000 + 1)) as slot from job_events)
          group by slot, stage)""")
def backlog_windows(t: Tables) -> DataFrame:
    samples = t.job_events.select(
        F.timestamp_micros("us").alias("ts"), F.col("stage").alias("queue"), F.col("k").alias("depth")
    )
    return ev.backlog(samples, "5 hours", "1 hour").select(_hour(), "queue", "least_depth", "alert")


@query("stale_windows", """
    select slot as window_hour, count(*) as actions, count(*) > 3 as alert from hour_slots
    where event_type = 'JOB_FAILED' group by slot""")
def stale_windows(t: Tables) -> DataFrame:
    actions = t.job_events.where("event_type = 'JOB_FAILED'").select(F.timestamp_micros("us").alias("ts"))
    return ev.frequent(actions, "15 hours", "1 hour").select(_hour(), "actions", "alert")


# Sparse events again: the throttle waits 20 hours where a worker waits one second.
THROTTLE_US = 20 * 3_600_000_000
add_view("progress_ordered", """
    select job_id, event_id, us, stage, k // 10 as percent, 'm' || (k % 2) as message,
           row_number() over (partition by job_id order by us, event_id) as rn
    from (select * replace (['EXTRACTING_AUDIO', 'TRANSCRIBING'][(1 + k // 50)::int] as stage) from job_events)""")
add_view("progress_walk", f"""
    select job_id, rn, event_id, us as last_us, stage as last_stage, percent as last_percent, message as last_message, true as sent
    from progress_ordered where rn = 1
    union all
    select job_id, rn, event_id, case when pass then us else last_us end, case when pass then stage else last_stage end,
           case when pass then percent else last_percent end, case when pass then message else last_message end, pass
    from (select x.*, last_us, last_stage, last_percent, last_message,
                 x.stage <> last_stage or (not (x.percent = last_percent and x.message = last_message)
                   and x.us - last_us >= {THROTTLE_US}) as pass
          from progress_walk w join progress_ordered x on x.job_id = w.job_id and x.rn = w.rn + 1)""", recursive=True)


def progress_updates(t: Tables) -> DataFrame:
    k = F.col("k")
    return t.job_events.select(
        "job_id", "event_id", "us", F.when(k < 50, "EXTRACTING_AUDIO").otherwise("TRANSCRIBING").alias("stage"),
        F.floor(k / 10).cast("long").alias("percent"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("message"),
    )


@query("progress_throttle", "select job_id, event_id from progress_walk where sent")
def progress_throttle(t: Tables) -> DataFrame:
    return ev.throttle_progress(progress_updates(t), interval_us=THROTTLE_US).select("job_id", "event_id")


@query("high_water_mark", """
    select job_id, event_id, k from (
      select *, coalesce(max(k) over (partition by job_id order by us, event_id rows between unbounded preceding and 1 preceding), 0) as mark
      from job_events) where k > mark""")
def high_water_mark(t: Tables) -> DataFrame:
    rows = t.job_events.select("job_id", "event_id", "us", "k")
    return ev.high_water_mark(rows, "k").select("job_id", "event_id", "k")
