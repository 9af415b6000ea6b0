"""Hit rates, false positives, AUC, score summaries and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.catalog import query
from clipstride.catalog.inputs import KEYWORDS, Tables, add_view
from clipstride.catalog.moments import responses
from clipstride.operators import evaluation as ev
from clipstride.operators.store import fresh_path
from clipstride.plans.evaluate import compare_on
from clipstride.sources.results import Request, freeze, replay

TOLERANCE = 2.0


def _candidates(t: Tables) -> DataFrame:
    return t.moments.withColumnRenamed("job_id", "source")


add_view("hit_labels", """
    select l.*, exists (select 1 from moments m where m.job_id = l.source
             and (l.start_sec + l.end_sec) / 2 between m.start_sec - 2 and m.end_sec + 2) as hit
    from gt_labels l""")
add_view("false_moments", """
    select m.*, not exists (select 1 from gt_labels l where l.source = m.job_id
             and (l.start_sec + l.end_sec) / 2 between m.start_sec - 2 and m.end_sec + 2) as false_positive
    from moments m""")


@query("eval_label_hits", "select source, label_id, start_sec, end_sec, hit from hit_labels")
def eval_label_hits(t: Tables) -> DataFrame:
    return ev.label_hits(t.gt_labels, _candidates(t), TOLERANCE).select(
        "source", "label_id", "start_sec", "end_sec", "hit"
    )


@query("eval_false_positives", "select job_id as source, moment_id, false_positive from false_moments")
def eval_false_positives(t: Tables) -> DataFrame:
    return ev.false_positives(_candidates(t), t.gt_labels, TOLERANCE).select("source", "moment_id", "false_positive")


@query("eval_metrics", """
    select source, case when count(hit) > 0 then count(*) filter (hit) / count(hit)::double else 0e0 end as hit_rate,
           count(*) filter (hit) as hits, count(hit) - count(*) filter (hit) as misses,
           count(*) filter (false_positive) as false_positives, count(hit) as total_labels,
           count(false_positive) as total_candidates
    from (select source, hit, null as false_positive from hit_labels
          union all select job_id, null, false_positive from false_moments) group by source""")
def eval_metrics(t: Tables) -> DataFrame:
    return ev.metrics(t.gt_labels, _candidates(t), TOLERANCE)


@query("compare_detectors", """
    with pairs as (select l.source, l.label_id, d.detector, exists (select 1 from moments m where m.job_id = l.source
                     and m.detector = d.detector and (l.start_sec + l.end_sec) / 2 between m.start_sec - 2 and m.end_sec + 2) as hit
                   from gt_labels l, (values ('signup'), ('error')) d(detector))
    select detector, source, case when count(hit) > 0 then count(*) filter (hit) / count(hit)::double else 0e0 end as hit_rate,
           count(*) filter (hit) as hits, count(hit) - count(*) filter (hit) as misses,
           count(*) filter (false_positive) as false_positives, count(hit) as total_labels,
           count(false_positive) as total_candidates
    from (select detector, source, hit, null as false_positive from pairs
          union all select detector, job_id, null, false_positive from false_moments) group by detector, source""")
def compare_detectors(t: Tables) -> DataFrame:
    return ev.compare_detectors(t.gt_labels, _candidates(t), ["signup", "error"], TOLERANCE)


add_view("judged", """
    select d.doc_id, source, n_chars, quality = 1 as is_true from documents d join labels l on l.doc_id = d.doc_id""")


def _judged(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", "source", "n_chars").join(t.table("labels"), "doc_id").select(
        "doc_id", "source", "n_chars", (F.col("quality") == 1).alias("is_true")
    )


@query("auc", """
    with ranked as (select *, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2e0 as rank from judged)
    select (count(*) filter (is_true))::bigint as positives, (count(*) filter (not is_true))::bigint as negatives,
           round((sum(rank) filter (is_true) - count(*) filter (is_true) * (count(*) filter (is_true) + 1) / 2e0)
             / nullif(count(*) filter (is_true) * count(*) filter (not is_true), 0), 9) as auc from ranked""")
def auc(t: Tables) -> DataFrame:
    return ev.auc(_judged(t), "n_chars", "is_true")


@query("auc_by_source", """
    select a.source, count(*) as positives, any_value(n) as negatives, round(avg(share), 9) as auc
    from (select t.source, t.doc_id, avg(case when t.n_chars > o.n_chars then 1e0 when t.n_chars = o.n_chars then 0.5e0 else 0e0 end) as share,
                 count(*) as n
          from judged t join judged o on o.source = t.source and not o.is_true where t.is_true group by all) a group by a.source
    union all
    select source, count(*) filter (is_true), count(*) filter (not is_true), null from judged group by source
    having count(*) filter (is_true) = 0 or count(*) filter (not is_true) = 0""")
def auc_by_source(t: Tables) -> DataFrame:
    return ev.auc(_judged(t), "n_chars", "is_true", ["source"])


@query("score_summary", """
    with s as (select source, is_true, case when doc_id % 10 <> 0 then n_chars end as score from judged),
    ranked as (select *, row_number() over (partition by source, is_true order by score) - 1 as nth,
                      count(*) over (partition by source, is_true) as size from s where score is not null)
    select u.source, unparseable, coalesce(n_true, 0) as n_true, coalesce(n_other, 0) as n_other, median_true, median_other,
           max_true, max_other
    from (select source, count(*) filter (score is null) as unparseable from s group by source) u
    left join (select source, count(*) filter (is_true) as n_true, count(*) filter (not is_true) as n_other,
                 max(case when is_true and nth = size // 2 then score end) as median_true,
                 max(case when not is_true and nth = size // 2 then score end) as median_other,
                 max(case when is_true then score end) as max_true, max(case when not is_true then score end) as max_other
               from ranked group by source) r on r.source = u.source""")
def score_summary(t: Tables) -> DataFrame:
    scored = _judged(t).withColumn("score", F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")))
    return ev.score_summary(scored, "score", "is_true", ["source"])


@query("context_text", """
    select m.job_id, moment_id, coalesce(trim(regexp_replace(string_agg(trim(text), ' ' order by s.start_sec, segment_id), '\\s+', ' ', 'g')), '') as context
    from moments m left join segments s on s.job_id = m.job_id and trim(text) <> ''
      and s.end_sec >= (m.start_sec + m.end_sec) / 2 - 20 and s.start_sec <= (m.start_sec + m.end_sec) / 2 + 20
    group by m.job_id, moment_id""")
def context_text(t: Tables) -> DataFrame:
    centres = t.moments.select(
        "job_id", F.col("moment_id").alias("span_id"), ((F.col("start_sec") + F.col("end_sec")) / 2.0).alias("centre_sec")
    )
    return ev.context_text(centres, t.segments, 20.0).select("job_id", F.col("span_id").alias("moment_id"), "context")


add_view("routed", """
    select job_id, start_sec, end_sec, confidence as score from merged where job_id % 3 <> 0
    union all
    select job_id, start_sec, end_sec, score from detected
    where job_id % 3 = 0 or job_id not in (select job_id from moments)""")


@query("replay_comparison", """
    with found as (select 'heuristic' as detector, job_id, start_sec, end_sec from detected
                   union all select 'hybrid', job_id, start_sec, end_sec from routed),
    pairs as (select l.source, d.detector, exists (select 1 from found m where m.job_id = l.source and m.detector = d.detector
                and (l.start_sec + l.end_sec) / 2 between m.start_sec - 2 and m.end_sec + 2) as hit
              from gt_labels l, (values ('heuristic'), ('hybrid')) d(detector)),
    wrong as (select detector, job_id as source, not exists (select 1 from gt_labels l where l.source = m.job_id
                and (l.start_sec + l.end_sec) / 2 between m.start_sec - 2 and m.end_sec + 2) as false_positive from found m)
    select detector, source, case when count(hit) > 0 then count(*) filter (hit) / count(hit)::double else 0e0 end as hit_rate,
           count(*) filter (hit) as hits, count(hit) - count(*) filter (hit) as misses,
           count(*) filter (false_positive) as false_positives, count(hit) as total_labels,
           count(false_positive) as total_candidates
    from (select detector, source, hit, null as false_positive from pairs
          union all select detector, source, null, false_positive from wrong) group by detector, source""")
def replay_comparison(t: Tables) -> DataFrame:
    """Frozen inputs of all recordings, read back and run through both detectors."""
    path = fresh_path(t.spark)
    keywords = F.array(*map(F.lit, KEYWORDS))
    params = t.segments.select("job_id").distinct().select(
        "job_id", F.lit(None).cast("double").alias("duration_sec"), F.lit(30.0).alias("window_duration_sec"),
        F.lit(None).cast("double").alias("step_sec"), F.lit(None).cast("int").alias("top_n"),
        F.lit(0.0).alias("min_overlap_ratio"), keywords.alias("emotion_keywords"),
    )
    freeze(Request(t.segments, t.silence, t.loudness, params), path)
    answers = responses(t).withColumn("failed", F.col("job_id") % 3 == 0)
    return compare_on(replay(t.spark, path), t.gt_labels, answers, KEYWORDS, TOLERANCE)
