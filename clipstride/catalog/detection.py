"""Windows, scores, selection, hook shift and the candidate gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.catalog import query
from clipstride.catalog.inputs import KEYWORDS, Tables, add_view, sql_hits
from clipstride.operators import scoring, snap, windows
from clipstride.operators.windows import WindowParams

P = WindowParams(keywords=KEYWORDS)

add_view("window_words", """
    select w.job_id, window_no, w_start, w_end, segment_id, pos, word, start_sec, end_sec
    from windows w join words x on x.job_id = w.job_id and x.start_sec < w.w_end and x.end_sec > w.w_start""")
add_view("window_counts", """
    select job_id, window_no, count(*) as n_words from window_words group by all""")
add_view("window_hits", f"""
    select job_id, window_no, sum({sql_hits('said')})::bigint as hits
    from (select job_id, window_no, segment_id, string_agg(word, ' ' order by pos) as said
          from window_words group by all) group by all""")
add_view("window_runs", """
    select job_id, window_no, max(run) as run_sec from (
      select job_id, window_no, island, max(e) - min(s) as run from (
        select *, sum(opens) over (partition by job_id, window_no order by s, e
                                   rows between unbounded preceding and current row) as island
        from (select *, case when before is null or s > before + 0.6e0 then 1 else 0 end as opens
              from (select job_id, window_no, greatest(start_sec, w_start) as s, least(end_sec, w_end) as e,
                           max(least(end_sec, w_end)) over (partition by job_id, window_no
                             order by greatest(start_sec, w_start), least(end_sec, w_end)
                             rows between unbounded preceding and 1 preceding) as before
                    from window_words)))
      group by job_id, window_no, island) group by all""")
add_view("window_quiet", """
    select w.job_id, window_no, sum(least(end_sec, w_end) - greatest(start_sec, w_start)) as quiet_sec
    from windows w join silence q on q.job_id = w.job_id and q.start_sec < w.w_end and q.end_sec > w.w_start
    group by all""")
add_view("window_loud", """
    select job_id, window_no, max(rms_db) as peak_db, min(case when rms_db = top then time_sec end) as peak_time_sec
    from (select w.job_id, window_no, rms_db, time_sec, max(rms_db) over (partition by w.job_id, window_no) as top
          from windows w join loudness l on l.job_id = w.job_id and l.time_sec >= w.w_start and l.time_sec < w.w_end)
    group by all""")
add_view("metrics", """
    select w.job_id, w.window_no, w_start, w_end,
           coalesce(n_words, 0) / (w_end - w_start) as speech_density,
           least(1e0, coalesce(quiet_sec, 0e0) / (w_end - w_start)) as silence_ratio,
           coalesce(hits, 0) as emotion_hits,
           least(1e0, coalesce(run_sec, 0e0) / (w_end - w_start)) as continuity_score,
           peak_db, peak_time_sec
    from windows w
    left join window_counts c on c.job_id = w.job_id and c.window_no = w.window_no
    left join window_hits h on h.job_id = w.job_id and h.window_no = w.window_no
    left join window_runs r on r.job_id = w.job_id and r.window_no = w.window_no
    left join window_quiet q on q.job_id = w.job_id and q.window_no = w.window_no
    left join window_loud l on l.job_id = w.job_id and l.window_no = w.window_no""")
add_view("norms", """
    select job_id, max(speech_density) as max_density, max(emotion_hits) as max_hits, min(peak_db) as min_db,
           max(peak_db) - min(peak_db) as range_db, count(peak_db) > 0 as has_loudness
    from metrics group by job_id""")


def _score(metrics: str, order: str = "") -> str:
    loud = """(case when has_loudness and peak_db is not null then
                 case when range_db > 0 then (peak_db - min_db) / range_db else 1e0 end else 0e0 end)"""
    hits = "(case when max_hits > 0 then emotion_hits / max_hits::double else 0e0 end)"
    density = "(case when max_density > 0 then speech_density / max_density else 0e0 end)"
    return f"""
    select m.*, round({loud}, 6) as loudness,
           round(case when has_loudness
             then 0.45e0 * {loud} + 0.2e0 * {hits} + 0.2e0 * continuity_score + 0.15e0 * (1e0 - silence_ratio)
             else 0.35e0 * {density} + 0.25e0 * (1e0 - silence_ratio) + 0.2e0 * {hits} + 0.2e0 * continuity_score
           end, 6) as total_score
    from {metrics} m join norms n on n.job_id = m.job_id {order}"""


add_view("scored", _score("metrics"))
add_view("scored_plain", """
    select m.*, round(0.35e0 * (case when max_density > 0 then speech_density / max_density else 0e0 end)
             + 0.25e0 * (1e0 - silence_ratio)
             + 0.2e0 * (case when max_hits > 0 then emotion_hits / max_hits::double else 0e0 end)
             + 0.2e0 * continuity_score, 6) as total_score
    from metrics m join norms n on n.job_id = m.job_id""")


def _greedy(source: str, order: str, conflict: str, keep: str, key: str = "job_id") -> tuple[str, str]:
    """Ordered rows, and a recursion over them that carries the list of kept rows."""
    ordered = f"select *, row_number() over (partition by {key} order by {order}) as rn from {source}"
    free = f"len(list_filter(w.kept, lambda k: {conflict})) = 0"
    walk = f"""
    select {key}, rn, true as taken, [{keep}] as kept from __ordered__ x where rn = 1
    union all
    select x.{key}, x.rn, {free}, case when {free} then list_append(w.kept, {keep}) else w.kept end
    from __walk__ w join __ordered__ x on x.{key} = w.{key} and x.rn = w.rn + 1"""
    return ordered, walk


def add_greedy(name: str, source: str, order: str, conflict: str, keep: str, key: str = "job_id") -> None:
    """View ``name``: the rows of ``source`` kept by the greedy rule."""
    ordered, walk = _greedy(source, order, conflict, keep, key)
    add_view(f"{name}_ordered", ordered)
    add_view(
        f"{name}_walk",
        walk.replace("__ordered__", f"{name}_ordered").replace("__walk__", f"{name}_walk"),
        recursive=True,
    )
    add_view(name, f"""
    select x.* exclude (rn) from {name}_ordered x
    join {name}_walk w on w.{key} = x.{key} and w.rn = x.rn and w.taken""")


add_greedy("selected", "scored", "total_score desc, w_start, w_end",
           "least(k.e, x.w_end) - greatest(k.s, x.w_start) > 0", "{'s': x.w_start, 'e': x.w_end}")


@query("sliding_windows", """
    select job_id, window_no, w_start as start_sec, w_end as end_sec from windows""")
def sliding_windows(t: Tables) -> DataFrame:
    lengths = windows.durations(t.segments, t.silence)
    return windows.sliding_windows(lengths, P).select(
        "job_id", "window_no", F.col("w_start").alias("start_sec"), F.col("w_end").alias("end_sec")
    )


def _metrics(t: Tables, loudness: bool = True) -> DataFrame:
    return windows.window_metrics(t.segments, t.silence, t.loudness if loudness else None, P)


@query("window_word_counts", """
    select job_id, window_no, round(speech_density * (w_end - w_start), 6) as n_words,
           round(speech_density, 6) as speech_density from metrics""")
def window_word_counts(t: Tables) -> DataFrame:
    return _metrics(t, False).select(
        "job_id", "window_no",
        F.round(F.col("speech_density") * (F.col("w_end") - F.col("w_start")), 6).alias("n_words"),
        F.round("speech_density", 6).alias("speech_density"),
    )


@query("window_emotion_hits", "select job_id, window_no, emotion_hits from metrics")
def window_emotion_hits(t: Tables) -> DataFrame:
    return _metrics(t, False).select("job_id", "window_no", "emotion_hits")


@query("window_silence_ratio", "select job_id, window_no, round(silence_ratio, 6) as silence_ratio from metrics")
def window_silence_ratio(t: Tables) -> DataFrame:
    return _metrics(t, False).select("job_id", "window_no", F.round("silence_ratio", 6).alias("silence_ratio"))


@query("window_speech_continuity",
       "select job_id, window_no, round(continuity_score, 6) as continuity_score from metrics")
def window_speech_continuity(t: Tables) -> DataFrame:
    return _metrics(t, False).select(
        "job_id", "window_no", F.round("continuity_score", 6).alias("continuity_score")
    )


@query("window_peak_loudness", "select job_id, window_no, peak_db from metrics")
def window_peak_loudness(t: Tables) -> DataFrame:
    return _metrics(t).select("job_id", "window_no", "peak_db")


@query("window_peak_time", "select job_id, window_no, peak_time_sec from metrics")
def window_peak_time(t: Tables) -> DataFrame:
    return _metrics(t).select("job_id", "window_no", "peak_time_sec")


@query("window_scores", """
    select job_id, window_no, w_start as start_sec, w_end as end_sec, round(speech_density, 6) as speech_density,
           round(silence_ratio, 6) as silence_ratio, emotion_hits, round(continuity_score, 6) as continuity_score,
           loudness, total_score from scored""")
def window_scores(t: Tables) -> DataFrame:
    return scoring.scored_windows(t.segments, t.silence, t.loudness, P).select(
        "job_id", "window_no", F.col("w_start").alias("start_sec"), F.col("w_end").alias("end_sec"),
        F.round("speech_density", 6).alias("speech_density"), F.round("silence_ratio", 6).alias("silence_ratio"),
        "emotion_hits", F.round("continuity_score", 6).alias("continuity_score"), "loudness", "total_score",
    )


@query("window_scores_no_loudness", "select job_id, window_no, total_score from scored_plain")
def window_scores_no_loudness(t: Tables) -> DataFrame:
    return scoring.scored_windows(t.segments, t.silence, None, P).select("job_id", "window_no", "total_score")


@query("segment_fallback_density", """
    select w.job_id, window_no,
           round(coalesce(sum(word_count * ((least(end_sec, w_end) - greatest(start_sec, w_start)) / (end_sec - start_sec))), 0)
                 / (w_end - w_start), 6) as speech_density
    from windows w left join segments s on s.job_id = w.job_id and s.start_sec < w.w_end and s.end_sec > w.w_start
    group by w.job_id, window_no, w_start, w_end""")
def segment_fallback_density(t: Tables) -> DataFrame:
    return windows.window_metrics(t.wordless, t.silence, None, P).select(
        "job_id", "window_no", F.round("speech_density", 6).alias("speech_density")
    )


@query("select_non_overlapping", "select job_id, w_start as start_sec, w_end as end_sec, total_score from selected")
def select_non_overlapping(t: Tables) -> DataFrame:
    scored = scoring.scored_windows(t.segments, t.silence, t.loudness, P)
    return scoring.select_non_overlapping(scored, P).select(
        "job_id", F.col("w_start").alias("start_sec"), F.col("w_end").alias("end_sec"), "total_score"
    )


add_greedy("selected_loose", "scored", "total_score desc, w_start, w_end",
           "(least(k.e, x.w_end) - greatest(k.s, x.w_start)) / (greatest(k.e, x.w_end) - least(k.s, x.w_start)) > 0.25e0",
           "{'s': x.w_start, 'e': x.w_end}")


@query("select_overlap_ratio", "select job_id, w_start as start_sec, w_end as end_sec, total_score from selected_loose")
def select_overlap_ratio(t: Tables) -> DataFrame:
    scored = scoring.scored_windows(t.segments, t.silence, t.loudness, P)
    return scoring.select_non_overlapping(scored, P, min_overlap_ratio=0.25).select(
        "job_id", F.col("w_start").alias("start_sec"), F.col("w_end").alias("end_sec"), "total_score"
    )


@query("select_top_n", """
    select job_id, w_start as start_sec, w_end as end_sec, total_score from selected
    qualify row_number() over (partition by job_id order by total_score desc, w_start, w_end) <= 3""")
def select_top_n(t: Tables) -> DataFrame:
    scored = scoring.scored_windows(t.segments, t.silence, t.loudness, P)
    return scoring.select_non_overlapping(scored, P, top_n=3).select(
        "job_id", F.col("w_start").alias("start_sec"), F.col("w_end").alias("end_sec"), "total_score"
    )


# Word edges are preferred to silence edges at equal distance, each in time order.
add_view("edges", """
    select job_id, seg_start as lo, seg_end as hi, unnest([start_sec, end_sec]) as edge, 0 as src, seg_start as o1,
           segment_id as o2, pos as o3, unnest([0, 1]) as o4
    from (select w.*, s.start_sec as seg_start, s.end_sec as seg_end
          from words w join segments s on s.job_id = w.job_id and s.segment_id = w.segment_id)
    union all
    select job_id, start_sec, end_sec, unnest([start_sec, end_sec]), 1, start_sec, 0, 0, unnest([0, 1]) from silence""")
add_view("aimed", """
    select *, case when peak_time_sec is not null
                then least(greatest(peak_time_sec - 0.4e0, w_start, 0e0), peak_time_sec) end as target
    from selected""")
add_view("snapped", """
    select a.job_id, a.window_no, a.w_start, a.w_end, a.peak_time_sec, a.total_score, a.target,
           coalesce(first(edge order by abs(edge - target), src, o1, o2, o3, o4), target) as snapped_sec
    from aimed a left join edges e on e.job_id = a.job_id and e.hi >= a.target - 0.6e0 and e.lo <= a.target + 0.6e0
                                  and abs(e.edge - a.target) < 1.6e0
    group by a.job_id, a.window_no, a.w_start, a.w_end, a.peak_time_sec, a.total_score, a.target""")
add_view("shifted", """
    select *, case when peak_time_sec is null then w_start else
             round(least(least(greatest(snapped_sec, w_start, 0e0), peak_time_sec), greatest(w_start, w_end - 8e0)), 6)
           end as clip_start
    from snapped""")


def _selected(t: Tables) -> DataFrame:
    scored = scoring.scored_windows(t.segments, t.silence, t.loudness, P)
    return scoring.select_non_overlapping(scored, P)


@query("nearest_boundary", "select job_id, window_no, target as target_sec, snapped_sec from snapped where target is not null")
def nearest_boundary(t: Tables) -> DataFrame:
    peak, start = F.col("peak_time_sec"), F.col("w_start")
    targets = _selected(t).where("peak_time_sec is not null").select(
        "job_id", "window_no",
        F.least(F.greatest(peak - snap.HOOK_LEAD_IN_SEC, start, F.lit(0.0)), peak).alias("target_sec"),
    )
    return snap.nearest_boundary(targets, t.segments, t.silence).select(
        "job_id", "window_no", "target_sec", "snapped_sec"
    )


@query("hook_shift", "select job_id, window_no, w_start, w_end, clip_start from shifted")
def hook_shift(t: Tables) -> DataFrame:
    return snap.shift_to_peak(_selected(t), t.segments, t.silence).select(
        "job_id", "window_no", "w_start", "w_end", "clip_start"
    )


# The clips measured again from their shifted start, by the same rules as the windows.
add_view("clips", "select job_id, window_no, clip_start as w_start, w_end from shifted")
add_view("clip_spoken", """
    select w.job_id, window_no, w_start, w_end, segment_id, pos, word, start_sec, end_sec
    from clips w join words x on x.job_id = w.job_id and x.start_sec < w.w_end and x.end_sec > w.w_start""")
add_view("clip_said", """
    select job_id, window_no, sum(hits)::bigint as hits, sum(n)::bigint as n_words,
           string_agg(said, ' ' order by segment_id) as excerpt
    from (select *, %s as hits from (
            select job_id, window_no, segment_id, count(*) as n, string_agg(word, ' ' order by pos) as said
            from clip_spoken group by all)) group by all""" % sql_hits("said"))
add_view("clip_runs", """
    select job_id, window_no, max(run) as run_sec from (
      select job_id, window_no, island, max(e) - min(s) as run from (
        select *, sum(opens) over (partition by job_id, window_no order by s, e
                                   rows between unbounded preceding and current row) as island
        from (select *, case when before is null or s > before + 0.6e0 then 1 else 0 end as opens
              from (select job_id, window_no, greatest(start_sec, w_start) as s, least(end_sec, w_end) as e,
                           max(least(end_sec, w_end)) over (partition by job_id, window_no
                             order by greatest(start_sec, w_start), least(end_sec, w_end)
                             rows between unbounded preceding and 1 preceding) as before
                    from clip_spoken)))
      group by job_id, window_no, island) group by all""")
add_view("clip_metrics", """
    select c.job_id, c.window_no, c.w_start, c.w_end, coalesce(n_words, 0) / (c.w_end - c.w_start) as speech_density,
           least(1e0, coalesce((select sum(least(end_sec, c.w_end) - greatest(start_sec, c.w_start)) from silence q
              where q.job_id = c.job_id and q.start_sec < c.w_end and q.end_sec > c.w_start), 0e0)
              / (c.w_end - c.w_start)) as silence_ratio,
           coalesce(hits, 0) as emotion_hits,
           least(1e0, coalesce(run_sec, 0e0) / (c.w_end - c.w_start)) as continuity_score,
           (select max(rms_db) from loudness l where l.job_id = c.job_id and l.time_sec >= c.w_start
              and l.time_sec < c.w_end) as peak_db, excerpt
    from clips c
    left join clip_said s on s.job_id = c.job_id and s.window_no = c.window_no
    left join clip_runs r on r.job_id = c.job_id and r.window_no = c.window_no""")
add_view("clip_scored", _score("clip_metrics"))
add_view("detected", """
    select s.job_id, clip_start as start_sec, s.w_end as end_sec,
           case when clip_start > s.w_start then c.total_score else s.total_score end as score,
           coalesce(excerpt, '') as excerpt
    from shifted s join clip_scored c on c.job_id = s.job_id and c.window_no = s.window_no""")


@query("rescored_candidates", "select job_id, start_sec, end_sec, score, excerpt from detected")
def rescored_candidates(t: Tables) -> DataFrame:
    return scoring.clip_candidates(t.segments, t.silence, t.loudness, scoring.DetectorParams(P))


add_view("passing_clips", "select * from detected where length(trim(excerpt)) >= 3 and score >= 0.5")
add_greedy("thinned_clips", "passing_clips", "score desc, start_sec, end_sec, excerpt",
           "abs(k - (x.start_sec + x.end_sec) / 2) <= 45", "(x.start_sec + x.end_sec) / 2")
add_view("gated_clips", """
    select * from thinned_clips""")


@query("detect_and_gate", "select job_id, start_sec, end_sec, score, excerpt from gated_clips")
def detect_and_gate(t: Tables) -> DataFrame:
    found = scoring.clip_candidates(t.segments, t.silence, t.loudness, scoring.DetectorParams(P))
    return scoring.candidate_gate(found)


def _pool(t: Tables) -> DataFrame:
    return t.moments.select("job_id", "start_sec", "end_sec", F.col("confidence").alias("score"),
                            F.col("reason").alias("excerpt"))


add_view("pool", "select job_id, start_sec, end_sec, confidence as score, reason as excerpt from moments")
add_greedy("thinned", "pool", "score desc, start_sec, end_sec, excerpt",
           "abs(k - (x.start_sec + x.end_sec) / 2) <= 45", "(x.start_sec + x.end_sec) / 2")
add_view("passing", "select * from pool where length(trim(excerpt)) >= 3 and score >= 0.5")
add_greedy("gated", "passing", "score desc, start_sec, end_sec, excerpt",
           "abs(k - (x.start_sec + x.end_sec) / 2) <= 45", "(x.start_sec + x.end_sec) / 2")


@query("temporal_nms", "select job_id, start_sec, end_sec, score, excerpt from thinned")
def temporal_nms(t: Tables) -> DataFrame:
    return scoring.temporal_nms(_pool(t))


@query("candidate_gate", """
    select job_id, start_sec, end_sec, score, excerpt from gated""")
def candidate_gate(t: Tables) -> DataFrame:
    return scoring.candidate_gate(_pool(t))
