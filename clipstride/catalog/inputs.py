"""The recording tables, derived from the given star-schema, event and text tables.

Every view exists twice: as a DataFrame (``Tables``) and as SQL text (``VIEWS``),
with the same columns.  FIXTURES.md describes them.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipstride.operators.scan import Running, ordinal, running
from clipstride.operators.store import written

KEYWORDS = ("the", "que", "und", "of the")
WORD_MS = 400
PAUSE_MS = 1500
#: Bytes of text, and events, that one task puts in order, about: more of them make more tasks, not larger ones.
TASK_BYTES, TASK_EVENTS = 16_000_000, 250_000


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold times without a zone
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def turns(self) -> DataFrame:
        text = F.col("text")
        rows = self.table("conversations").select(
            F.col("conv_id").alias("job_id"), F.col("turn").alias("segment_id"), text.alias("text"),
            F.filter(F.split(text, r"\s+"), lambda t: t != "").alias("tokens"),
        ).withColumn("n", F.size("tokens").cast("long"))
        size = self.table("conversations").agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return written(
            running(
                rows, ["job_id"], F.floor(F.col("segment_id") / 256), [F.col("segment_id")], math.ceil(size / TASK_BYTES),
                start_ms=Running("sum", F.col("n") * WORD_MS + PAUSE_MS),
            )
        )

    @cached_property
    def segments(self) -> DataFrame:
        base = F.col("start_ms")
        words = F.transform(
            "tokens",
            lambda w, i: F.struct(
                w.alias("word"),
                ((base + i * WORD_MS) / F.lit(1000.0)).alias("start_sec"),
                ((base + (i + 1) * WORD_MS) / F.lit(1000.0)).alias("end_sec"),
            ),
        )
        return self.turns.select(
            "job_id", "segment_id",
            (base / F.lit(1000.0)).alias("start_sec"),
            ((base + F.col("n") * WORD_MS) / F.lit(1000.0)).alias("end_sec"),
            "text", F.col("n").cast("int").alias("word_count"), words.alias("words"),
        )

    @cached_property
    def wordless(self) -> DataFrame:
        """The same transcript without word timings."""
        return self.segments.withColumn("words", F.filter("words", lambda w: F.lit(False)))

    @cached_property
    def silence(self) -> DataFrame:
        end = F.col("start_ms")
        return self.turns.where("start_ms > 0").select(
            "job_id",
            ((end - PAUSE_MS) / F.lit(1000.0)).alias("start_sec"),
            (end / F.lit(1000.0)).alias("end_sec"),
            F.lit(PAUSE_MS / 1000.0).alias("duration_sec"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))

    @cached_property
    def loudness(self) -> DataFrame:
        rows = self.events.select(F.col("user_id").alias("job_id"), "us", "event_id", "value")
        day = F.floor(F.col("us") / F.lit(86_400_000_000)).cast("long")
        tasks = math.ceil(self.table("events").count() / TASK_EVENTS)
        return written(ordinal(rows, ["job_id"], day, [F.col("us"), F.col("event_id")], "j", tasks).select(
            "job_id", (F.col("j") * F.lit(3.0)).alias("time_sec"), (-(F.col("value") / 10.0)).alias("rms_db")
        ))

    def _second(self, modulus: int):
        return (F.floor(F.col("us") / F.lit(1_000_000)).cast("long") % modulus).cast("double")

    @cached_property
    def chat(self) -> DataFrame:
        return self.events.where("event_type in ('click', 'view')").select(
            F.col("user_id").alias("job_id"), self._second(200).alias("offset_sec")
        )

    @cached_property
    def gt_labels(self) -> DataFrame:
        start = self._second(190)
        return self.events.where("event_type = 'purchase'").select(
            F.col("user_id").alias("source"), F.col("event_id").alias("label_id"),
            start.alias("start_sec"), (start + 5 + F.col("event_id") % 20).alias("end_sec"),
        )

    @cached_property
    def moments(self) -> DataFrame:
        start = self._second(190)
        return self.events.where("event_type in ('signup', 'error')").select(
            F.col("user_id").alias("job_id"), F.col("event_id").alias("moment_id"),
            start.alias("start_sec"), (start + 5 + F.col("event_id") % 40).alias("end_sec"),
            ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"),
            F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reason"),
            F.col("event_type").alias("detector"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
                 "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
        rows = self.table("lineitem")
        numbered = ordinal(rows, ["l_orderkey"], F.col("l_linenumber").cast("long"), [F.col(c) for c in order], "n")
        start = (F.col("l_partkey") % 3600).cast("double")
        status = F.col("l_returnflag")
        done = F.col("l_linestatus") == "F"
        n = F.col("n") + 1
        candidate_id = F.col("l_orderkey") * 100 + n
        return numbered.select(
            F.col("l_orderkey").alias("job_id"), n.alias("n"), candidate_id.alias("candidate_id"),
            start.alias("start_sec"), (start + 5 + F.col("l_quantity")).alias("end_sec"),
            F.round(1.0 - (F.col("l_discount") + 0.0) * 5.0, 2).alias("score"),
            F.when(status == "A", "APPROVED").when(status == "R", "REJECTED").otherwise("PENDING")
            .alias("moderation_status"),
            F.when(done, "COMPLETED").otherwise("NOT_REQUESTED").alias("export_status"),
            F.when(done, F.concat(F.lit("jobs\\"), F.col("l_orderkey").cast("string"), F.lit("\\exports/candidate-"),
                                  candidate_id.cast("string"), F.lit(".mp4"))).alias("exported_clip_path"),
            F.col("l_shipdate").alias("decided_at"),
            "l_partkey", "l_suppkey",
        )

    @cached_property
    def jobs(self) -> DataFrame:
        rank = F.substring("o_orderpriority", 1, 1)

        def pick(*names):
            out = F.when(rank == "1", names[0])
            for i, name in enumerate(names[1:], start=2):
                out = out.when(rank == str(i), name)
            return out

        status = (
            F.when(F.col("o_orderstatus") == "O", pick(*OPEN_STATES))
            .when(F.col("o_orderstatus") == "P", pick(*REVIEW_STATES))
            .otherwise(pick(*FINAL_STATES))
        )
        updated = F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_custkey") % 20).cast("int"))
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
            updated.alias("updated_at"),
            F.when((F.col("o_orderstatus") == "F") & (key % 11 != 0), updated).alias("finished_at"),
            F.when(key % 7 == 0, None).when(key % 13 == 0, "  ")
            .otherwise(F.concat(F.lit("store\\jobs/"), key.cast("string"), F.lit("/source.mp4")))
            .alias("storage_video_path"),
            F.when(key % 5 == 0, F.concat(F.lit("w"), (F.col("o_custkey") % 7).cast("string")))
            .alias("current_worker_id"),
            (1 + F.col("o_custkey") % 3).alias("processing_version"),
            F.when(key % 3 == 0, None).otherwise((F.col("o_totalprice") / 1000 - 20).cast("long"))
            .alias("progress_percent"),
            F.concat(F.lit("p"), (key % 4).cast("string")).alias("progress_message"),
            F.element_at(F.array(F.lit("URL"), F.lit("UPLOAD"), F.lit("TWITCH")), (key % 3 + 1).cast("int"))
            .alias("source_type"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        c = self.candidates
        attempts = (F.col("l_suppkey") % 4).cast("long")
        at = F.col("decided_at")
        kind = (F.col("n") % 3 + 1).cast("int")
        state = ((F.col("l_partkey") + F.col("n")) % 7 + 1).cast("int")
        return written(c.select(
            F.col("candidate_id").alias("task_id"), "job_id",
            F.element_at(F.array(*map(F.lit, TASK_TYPES)), kind).alias("task_type"),
            F.element_at(F.array(*map(F.lit, TASK_STATES)), state).alias("status"),
            attempts.alias("attempt_count"), F.lit(3).cast("long").alias("max_attempts"),
            F.when(F.col("l_partkey") % 5 != 0, at).alias("last_heartbeat_at"),
            F.when(F.col("l_partkey") % 9 != 0, at + F.make_dt_interval(days=attempts.cast("int"))).alias("available_at"),
            at.alias("created_at"),
            (at + F.make_dt_interval(days=F.lit(1))).alias("updated_at"),
            F.when(state >= 4, at + F.make_dt_interval(days=F.lit(2))).alias("finished_at"),
            F.when(state.isin(2, 3), at + F.make_dt_interval(hours=F.lit(6))).alias("claimed_at"),
            F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("f"), (F.col("l_partkey") % 10).cast("string")))
            .alias("failure_message"),
        ))

    @cached_property
    def executions(self) -> DataFrame:
        """One execution per task that was ever claimed."""
        return self.tasks.where("status <> 'QUEUED'").select(
            (F.col("task_id") + 7).alias("execution_id"), "task_id", "job_id", "task_type",
            F.when(F.col("status").isin("CLAIMED", "RUNNING"), F.col("status")).otherwise("DONE").alias("status"),
            F.concat(F.lit("w"), (F.col("task_id") % 7).cast("string")).alias("worker_id"),
            (1 + F.col("task_id") % 3).alias("processing_version"),
            F.when(F.col("task_type") == "EXPORT", F.col("task_id")).alias("candidate_id"),
            F.col("created_at").alias("claimed_at"),
        )

    @cached_property
    def job_events(self) -> DataFrame:
        kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
        k = F.from_json("props", "struct<k:long>")["k"]
        stages = F.array(*map(F.lit, PROGRESS_STAGES))
        return self.events.select(
            F.col("event_id").alias("event_id"), F.col("user_id").alias("job_id"), "us",
            kind[F.col("event_type")].alias("event_type"), k.alias("k"),
            F.element_at(stages, (k % 5 + 1).cast("int")).alias("stage"),
        )


# The states jobs and tasks go through, in the order used by the views.
OPEN_STATES = ("QUEUED_FOR_DOWNLOAD", "DOWNLOADING", "TRANSCRIBING", "ANALYZING_WINDOWS", "EXPORTING_CLIP")
REVIEW_STATES = ("READY_FOR_REVIEW", "READY_FOR_REVIEW", "READY_FOR_REVIEW", "QUEUED_FOR_PROCESSING", "NEW")
FINAL_STATES = ("COMPLETED", "COMPLETED", "COMPLETED", "FAILED", "CANCELED")
TASK_TYPES = ("DOWNLOAD", "ANALYZE", "EXPORT")
TASK_STATES = ("QUEUED", "CLAIMED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELED", "DEAD_LETTERED")
EVENT_TYPES = {
    "signup": "JOB_CREATED", "view": "JOB_CLAIMED", "click": "WORKER_PROGRESS",
    "purchase": "EXPORT_COMPLETED", "error": "JOB_FAILED",
}
PROGRESS_STAGES = (
    "EXTRACTING_AUDIO", "TRANSCRIBING", "DETECTING_SILENCE", "ANALYZING_WINDOWS", "GENERATING_CANDIDATES",
)


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def sql_hits(text: str, keywords=KEYWORDS) -> str:
    """Hits of whole words. What separates words is doubled first, so that every word has edges of its own in any alphabet."""
    edge = "[^\\p{L}\\p{M}\\p{N}_]"

    def whole(x: str, word: str) -> str:
        return f"len(regexp_extract_all(regexp_replace({x}, '({edge})', '\\1\\1', 'g'), '(?:^|{edge}){word}(?:{edge}|$)'))"

    parts = [whole(f"lower({text})", k.replace(" ", "  ")) for k in keywords]
    parts += [f"len(regexp_extract_all({text}, '!'))", whole(text, "[A-Z]{2,}")]
    return "(" + " + ".join(parts) + ")"


VIEWS: dict[str, str] = {
    "turns": f"""
        select job_id, segment_id, text, tokens, len(tokens) as n,
               coalesce(sum(len(tokens) * {WORD_MS} + {PAUSE_MS}) over (partition by job_id order by segment_id
                 rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms
        from (select conv_id as job_id, turn as segment_id, text,
                     list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') as tokens
              from conversations)""",
    "segments": f"""
        select job_id, segment_id, start_ms / 1000e0 as start_sec, (start_ms + n * {WORD_MS}) / 1000e0 as end_sec,
               text, n as word_count
        from turns""",
    "words": f"""
        select job_id, segment_id, i - 1 as pos, tokens[i] as word,
               (start_ms + (i - 1) * {WORD_MS}) / 1000e0 as start_sec, (start_ms + i * {WORD_MS}) / 1000e0 as end_sec
        from (select *, unnest(range(1, n + 1)) as i from turns)""",
    "silence": f"""
        select job_id, (start_ms - {PAUSE_MS}) / 1000e0 as start_sec, start_ms / 1000e0 as end_sec
        from turns where start_ms > 0""",
    "lengths": """
        select job_id, greatest(0e0, max(end_sec)) as duration_sec
        from (select job_id, end_sec from segments union all select job_id, end_sec from silence) group by job_id""",
    "windows": """
        select job_id, window_no, w_start,
               case when duration_sec <= 30 then duration_sec else w_start + 30e0 end as w_end
        from (select job_id, duration_sec, window_no, least(window_no * 5e0, greatest(0e0, duration_sec - 30e0)) as w_start
              from (select *, unnest(range(0, ceil(greatest(0e0, duration_sec - 30e0) / 5e0)::bigint + 1)) as window_no
                    from lengths where duration_sec > 0))""",
    "loudness": """
        select user_id as job_id, (row_number() over (partition by user_id order by ts, event_id) - 1) * 3e0 as time_sec,
               -(value / 10e0) as rms_db
        from events""",
    "chat": """
        select user_id as job_id, ((epoch_us(ts) // 1000000) % 200)::double as offset_sec
        from events where event_type in ('click', 'view')""",
    "gt_labels": """
        select user_id as source, event_id as label_id, ((epoch_us(ts) // 1000000) % 190)::double as start_sec,
               ((epoch_us(ts) // 1000000) % 190)::double + 5 + event_id % 20 as end_sec
        from events where event_type = 'purchase'""",
    "moments": """
        select user_id as job_id, event_id as moment_id, ((epoch_us(ts) // 1000000) % 190)::double as start_sec,
               ((epoch_us(ts) // 1000000) % 190)::double + 5 + event_id % 40 as end_sec,
               (event_id % 100) / 100e0 as confidence, 'r' || event_id as reason, event_type as detector
        from events where event_type in ('signup', 'error')""",
    "candidates": """
        select job_id, n, job_id * 100 + n as candidate_id, (l_partkey % 3600)::double as start_sec,
               (l_partkey % 3600)::double + 5 + l_quantity as end_sec,
               round(1e0 - (l_discount + 0e0) * 5e0, 2) as score,
               case l_returnflag when 'A' then 'APPROVED' when 'R' then 'REJECTED' else 'PENDING' end as moderation_status,
               case l_linestatus when 'F' then 'COMPLETED' else 'NOT_REQUESTED' end as export_status,
               case l_linestatus when 'F'
                 then 'jobs\\' || job_id || '\\exports/candidate-' || (job_id * 100 + n) || '.mp4' end as exported_clip_path,
               l_shipdate as decided_at, l_partkey, l_suppkey
        from (select *, l_orderkey as job_id,
                     row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
                       l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as n
              from lineitem)""",
    "jobs": f"""
        select o_orderkey as job_id,
               (case o_orderstatus when 'O' then {_list(OPEN_STATES)} when 'P' then {_list(REVIEW_STATES)}
                  else {_list(FINAL_STATES)} end)[substr(o_orderpriority, 1, 1)::int] as status,
               o_orderdate as created_at,
               o_orderdate + to_days((o_custkey % 20)::int) as updated_at,
               case when o_orderstatus = 'F' and o_orderkey % 11 <> 0
                 then o_orderdate + to_days((o_custkey % 20)::int) end as finished_at,
               case when o_orderkey % 7 = 0 then null when o_orderkey % 13 = 0 then '  '
                 else 'store\\jobs/' || o_orderkey || '/source.mp4' end as storage_video_path,
               case when o_orderkey % 5 = 0 then 'w' || (o_custkey % 7) end as current_worker_id,
               1 + o_custkey % 3 as processing_version,
               case when o_orderkey % 3 <> 0 then trunc(o_totalprice / 1000 - 20)::bigint end as progress_percent,
               'p' || (o_orderkey % 4) as progress_message,
               ['URL', 'UPLOAD', 'TWITCH'][(o_orderkey % 3 + 1)::int] as source_type
        from orders""",
    "tasks": f"""
        select candidate_id as task_id, job_id, {_list(TASK_TYPES)}[(n % 3 + 1)::int] as task_type,
               {_list(TASK_STATES)}[((l_partkey + n) % 7 + 1)::int] as status,
               l_suppkey % 4 as attempt_count, 3::bigint as max_attempts,
               case when l_partkey % 5 <> 0 then decided_at end as last_heartbeat_at,
               case when l_partkey % 9 <> 0 then decided_at + to_days((l_suppkey % 4)::int) end as available_at,
               decided_at as created_at, decided_at + to_days(1) as updated_at,
               case when (l_partkey + n) % 7 + 1 >= 4 then decided_at + to_days(2) end as finished_at,
               case when (l_partkey + n) % 7 + 1 in (2, 3) then decided_at + to_hours(6) end as claimed_at,
               case when l_partkey % 2 = 0 then 'f' || (l_partkey % 10) end as failure_message
        from candidates""",
    "executions": """
        select task_id + 7 as execution_id, task_id, job_id, task_type,
               case when status in ('CLAIMED', 'RUNNING') then status else 'DONE' end as status,
               'w' || (task_id % 7) as worker_id, 1 + task_id % 3 as processing_version,
               case when task_type = 'EXPORT' then task_id end as candidate_id, created_at as claimed_at
        from tasks where status <> 'QUEUED'""",
    "job_events": f"""
        select event_id, user_id as job_id, epoch_us(ts) as us,
               case event_type {" ".join(f"when '{a}' then '{b}'" for a, b in EVENT_TYPES.items())} end as event_type,
               k, {_list(PROGRESS_STAGES)}[(k % 5 + 1)::int] as stage
        from (select *, (props->>'k')::bigint as k from events)""",
}


RECURSIVE: set[str] = set()


def add_view(name: str, body: str, *, recursive: bool = False) -> None:
    VIEWS[name] = body
    if recursive:
        RECURSIVE.add(name)


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it (transitively) names, as common table expressions."""
    needed: list[str] = []
    open_views: set[str] = set()

    def visit(text: str, own: str | None = None) -> None:
        for name in VIEWS:
            if name != own and name not in needed and name not in open_views and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                open_views.add(name)
                visit(VIEWS[name], name)
                open_views.discard(name)
                needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(
        f"{n} as {'' if n in RECURSIVE else 'materialized '}({VIEWS[n].strip()})" for n in needed
    )
    body = body.strip()
    rest = f",\n{body[5:]}" if body.startswith("with ") else f"\n{body}"
    return f"with recursive {ctes}{rest}"
