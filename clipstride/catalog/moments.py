"""Chunks, prompts, model answers, merged moments and fused ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.catalog import SQL, query
from clipstride.catalog.detection import add_greedy
from clipstride.catalog.inputs import KEYWORDS, Tables, add_view, sql_hits
from clipstride.functions import responses as rs
from clipstride.operators import fusion
from clipstride.operators import moments as mo
from clipstride.operators import windows
from clipstride.operators.store import written

# The recordings are minutes long, so chunks are scaled down to have several of them.
CHUNK, STEP = 60.0, 48.0

add_view("chunks", """
    select job_id, chunk_no, chunk_no * 480e0 as c_start, least(chunk_no * 480e0 + 600e0, duration_sec) as c_end
    from (select *, unnest(range(0, case when duration_sec <= 600 then 1
                                    else ceil((duration_sec - 600e0) / 480e0)::bigint + 1 end)) as chunk_no
          from lengths where duration_sec > 0 and job_id in (select job_id from segments))""")
add_view("small_chunks", """
    select job_id, chunk_no, chunk_no * 48e0 as c_start, least(chunk_no * 48e0 + 60e0, duration_sec) as c_end
    from (select *, unnest(range(0, case when duration_sec <= 60 then 1
                                    else ceil((duration_sec - 60e0) / 48e0)::bigint + 1 end)) as chunk_no
          from lengths where duration_sec > 0 and job_id in (select job_id from segments))""")


def _lengths(t: Tables) -> DataFrame:
    return windows.durations(t.segments, t.silence)


@query("chunks", "select * from chunks union all select job_id, chunk_no + 1000, c_start, c_end from small_chunks")
def chunks(t: Tables) -> DataFrame:
    small = mo.chunks(_lengths(t), t.segments, CHUNK, STEP).withColumn("chunk_no", F.col("chunk_no") + 1000)
    return mo.chunks(_lengths(t), t.segments).unionByName(small)


@query("chunk_segments", """
    select c.job_id, chunk_no, segment_id from small_chunks c
    join segments s on s.job_id = c.job_id and s.start_sec < c_end and s.end_sec > c_start""")
def chunk_segments(t: Tables) -> DataFrame:
    slim = t.segments.select("job_id", "segment_id", "start_sec", "end_sec")
    return mo.into_chunks(slim, _lengths(t), "start_sec", "end_sec", CHUNK, STEP).where(
        "start_sec < c_end and end_sec > c_start"
    ).select("job_id", "chunk_no", "segment_id")


add_view("chunk_peaks", """
    select * from (select c.job_id, chunk_no, row_number() over (partition by c.job_id, chunk_no order by rms_db desc, time_sec) as rank,
                          time_sec, rms_db
                   from chunks c join loudness l on l.job_id = c.job_id and time_sec >= c_start and time_sec < c_end)
    where rank <= 5""")
add_view("chunk_emotion", f"""
    select c.job_id, chunk_no, segment_id, start_sec as time_sec, trim(text) as hint
    from chunks c join segments s on s.job_id = c.job_id and s.start_sec < c_end and s.end_sec > c_start
    where {sql_hits('text')} > 0""")
add_view("chunk_quiet", """
    select c.job_id, chunk_no, greatest(start_sec, c_start) as from_sec, least(end_sec, c_end) as to_sec
    from chunks c join silence s on s.job_id = c.job_id and s.start_sec < c_end and s.end_sec > c_start""")


@query("chunk_loudness_peaks", "select * from chunk_peaks")
def chunk_loudness_peaks(t: Tables) -> DataFrame:
    spoken = _lengths(t)
    return mo.loudness_peaks(t.loudness, spoken)


@query("chunk_emotion_hints", "select * from chunk_emotion")
def chunk_emotion_hints(t: Tables) -> DataFrame:
    return mo.emotion_hints(t.segments, _lengths(t), KEYWORDS)


@query("chunk_silences", "select * from chunk_quiet")
def chunk_silences(t: Tables) -> DataFrame:
    return mo.silence_hints(t.silence, _lengths(t))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _f1(x: str) -> str:
    return f"printf('%.1f', {x})"


@query("chunk_prompts", f"""
    with said as (select c.job_id, chunk_no, string_agg('[' || {_f1('start_sec')} || 's - ' || {_f1('end_sec')} || 's] ' || trim(text),
                         chr(10) order by start_sec, segment_id) as lines
                  from chunks c join segments s on s.job_id = c.job_id and s.start_sec < c_end and s.end_sec > c_start group by all),
    peaks as (select job_id, chunk_no, string_agg('- ' || {_f1('time_sec')} || 's: ' || {_f1('rms_db')} || ' dB', chr(10) order by rank) as lines
              from chunk_peaks group by all),
    excited as (select job_id, chunk_no, string_agg('- ' || {_f1('time_sec')} || 's: ' || hint, chr(10) order by time_sec, segment_id) as lines
                from chunk_emotion group by all),
    quiet as (select job_id, chunk_no, string_agg('- ' || {_f1('from_sec')} || 's to ' || {_f1('to_sec')} || 's', chr(10) order by from_sec) as lines
              from chunk_quiet group by all)
    select c.job_id, c.chunk_no, c_start, c_end,
           {_q(mo.INTRO)} || printf('%.0f', c_start) || 's to ' || printf('%.0f', c_end) || 's.' || chr(10) || chr(10)
           || 'Transcript:' || chr(10) || coalesce(said.lines, {_q(mo.NO_SPEECH)}) || chr(10) || chr(10) || 'Hints:' || chr(10)
           || coalesce(nullif(concat_ws(chr(10) || chr(10), {_q(mo.SECTIONS['peak'])} || chr(10) || peaks.lines,
                {_q(mo.SECTIONS['emotion'])} || chr(10) || excited.lines, {_q(mo.SECTIONS['silence'])} || chr(10) || quiet.lines), ''),
                {_q(mo.NO_HINTS)})
           || chr(10) || chr(10) || {_q(mo.ANSWER)} as prompt
    from chunks c
    left join said on said.job_id = c.job_id and said.chunk_no = c.chunk_no
    left join peaks on peaks.job_id = c.job_id and peaks.chunk_no = c.chunk_no
    left join excited on excited.job_id = c.job_id and excited.chunk_no = c.chunk_no
    left join quiet on quiet.job_id = c.job_id and quiet.chunk_no = c.chunk_no""")
def chunk_prompts(t: Tables) -> DataFrame:
    return mo.prompts(t.segments, t.silence, t.loudness, _lengths(t), KEYWORDS)


def responses(t: Tables) -> DataFrame:
    """Answers holding up to 32 moments each, written in four styles."""
    m = t.moments.withColumn("response_no", F.floor(F.col("moment_id") / 32).cast("long"))
    camel = F.col("moment_id") % 7 == 0
    style = (F.col("job_id") + F.col("response_no")) % 4
    item = F.concat(
        F.when(camel, '{"startSec": ').otherwise('{"start_sec": '), F.col("start_sec").cast("string"),
        F.when(camel, ', "endSec": ').otherwise(', "end_sec": '), F.col("end_sec").cast("string"),
        F.lit(', "reason": "'), F.col("reason"), F.lit('", "confidence": '), F.col("confidence").cast("string"), F.lit("}"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("moment_id", item.alias("item")))),
                                      lambda x: x["item"]), ", ")
    texts = m.groupBy("job_id", "response_no").agg(joined.alias("items"))
    array = F.concat(F.lit("["), F.col("items"), F.lit("]"))
    return texts.select(
        "job_id", "response_no",
        F.when(style == 0, array)
        .when(style == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
        .when(style == 2, F.concat(F.lit("Here you go: "), array, F.lit(" Enjoy!")))
        .otherwise(F.concat(F.lit("I found "), F.col("items"), F.lit(" and no more."))).alias("raw"),
    )


add_view("answered", """
    select job_id, moment_id // 32 as response_no, row_number() over (partition by job_id, moment_id // 32 order by moment_id) - 1 as pos,
           start_sec, end_sec, reason, confidence from moments""")


@query("parse_responses", "select * from answered")
def parse_responses(t: Tables) -> DataFrame:
    return mo.parse_highlights(responses(t))


@query("parse_index_list", """
    select event_id, list_aggregate(list_transform(picks, lambda x: x::varchar), 'string_agg', ',') as picks
    from (select event_id, list_filter([event_id % 13, value::bigint % 9, event_id % 13, user_id % 20], lambda x, i: x < 12
                   and list_position([event_id % 13, value::bigint % 9, event_id % 13, user_id % 20], x) = i) as picks from
          (select event_id, user_id, floor(value) as value from events))""")
def parse_index_list(t: Tables) -> DataFrame:
    e, v, u = F.col("event_id"), F.floor("value").cast("long"), F.col("user_id")
    numbers = F.array_join(F.array(*[x.cast("string") for x in (e % 13, v % 9, e % 13, u % 20)]), ", ")
    raw = F.when(e % 2 == 0, F.concat(F.lit("Best: ["), numbers, F.lit("] of 99"))).otherwise(
        F.concat(F.lit("I keep "), numbers)
    )
    picks = F.array_join(F.transform(rs.index_list(raw, F.lit(12)), lambda x: x.cast("string")), ",")
    return t.events.select("event_id", F.when(picks != "", picks).alias("picks"))


@query("parse_scores", """
    select event_id, case event_id % 4 when 3 then null
             else greatest(0e0, least(1e0, case when v > 10 then v / 100e0 when v > 1 then v / 10e0 else v end)) end as score
    from (select event_id, case event_id % 4 when 0 then value when 1 then (event_id % 10)::double else (event_id % 100) / 100e0 end as v
          from events)""")
def parse_scores(t: Tables) -> DataFrame:
    e = F.col("event_id")
    raw = (
        F.when(e % 4 == 0, F.concat(F.lit("SCORE: "), F.col("value").cast("string")))
        .when(e % 4 == 1, (e % 10).cast("string"))
        .when(e % 4 == 2, F.concat((e % 100 / F.lit(100.0)).cast("string"), F.lit(" out of one")))
        .otherwise(F.lit("no number"))
    )
    return t.events.select("event_id", rs.model_score(raw).alias("score"))


add_greedy("merged", "moments", "confidence desc, moment_id",
           "(least(k.e, x.end_sec) - greatest(k.s, x.start_sec)) > 0 and "
           "(least(k.e, x.end_sec) - greatest(k.s, x.start_sec)) / (greatest(k.e, x.end_sec) - least(k.s, x.start_sec)) >= 0.3e0",
           "{'s': x.start_sec, 'e': x.end_sec}")


def _merged(t: Tables) -> DataFrame:
    return mo.merge_moments(t.moments, ["moment_id"])


@query("merge_moments", "select job_id, moment_id, start_sec, end_sec, confidence from merged")
def merge_moments(t: Tables) -> DataFrame:
    return _merged(t).select("job_id", "moment_id", "start_sec", "end_sec", "confidence")


add_view("merged_said", """
    select m.job_id, moment_id, string_agg(word, ' ' order by w.segment_id, pos) as excerpt
    from merged m join words w on w.job_id = m.job_id and w.start_sec < m.end_sec and w.end_sec > m.start_sec group by all""")


@query("moments_to_candidates", """
    select m.job_id, m.moment_id, start_sec, end_sec, round(confidence, 6) as score, coalesce(excerpt, '') as excerpt
    from (select * from merged qualify row_number() over (partition by job_id order by confidence desc, start_sec, moment_id) <= 8) m
    left join merged_said s on s.job_id = m.job_id and s.moment_id = m.moment_id""")
def moments_to_candidates(t: Tables) -> DataFrame:
    return mo.moments_to_candidates(written(_merged(t)), t.segments, top_n=8)


@query("batched_shortlist", """
    with placed as (select *, row_number() over (partition by job_id order by start_sec, end_sec, moment_id) - 1 as nth,
                           count(*) over (partition by job_id) as total from moments),
    kept as (select * from (select *, row_number() over (partition by job_id, nth // 20 order by confidence desc, nth) as n from placed)
             where n <= greatest(1, ceil(24e0 / ceil(total / 20e0))))
    select job_id, moment_id, confidence from kept
    qualify row_number() over (partition by job_id order by confidence desc, nth) <= 12""")
def batched_shortlist(t: Tables) -> DataFrame:
    return mo.shortlist(t.moments).select("job_id", "moment_id", "confidence")


@query("selection_prompts", """
    with placed as (select *, row_number() over (partition by job_id order by start_sec, end_sec, moment_id) - 1 as nth from merged)
    select p.job_id, nth // 20 as batch_no,
           'Choose at most 12 of these moments, best first. Answer with a JSON array of their numbers.' || chr(10)
           || string_agg('[' || (nth % 20) || '] ' || printf('%.0f', start_sec) || 's: ' || reason || ' | '
                         || coalesce(excerpt, ''), chr(10) order by nth) as prompt
    from placed p left join merged_said s on s.job_id = p.job_id and s.moment_id = p.moment_id group by all""")
def selection_prompts(t: Tables) -> DataFrame:
    return mo.selection_prompts(written(_merged(t)), t.segments)


def _picking(prompts: list[str]) -> list[str]:
    """A model whose picks follow from the length of what it is asked; at every fourth length it names none."""
    return [f"I pick [{n % 7}, {n % 5}, {n % 11}, {n % 2}]" if (n := len(p)) % 4 else "hard to say" for p in prompts]


def _picked_sql(rows: str, name: str) -> str:
    """CTEs that rank the lists of ``rows(job_id, list_no, idx, size, keep, confidence, told)`` into ``name``."""
    picks = "[n % 7, n % 5, n % 11, n % 2]"
    return f"""
    {name}_asked as (select job_id, list_no, any_value(size) as size, any_value(keep) as keep,
        length('Choose at most ' || any_value(keep) || ' of these moments, best first. Answer with a JSON array of their numbers.' || chr(10)
               || string_agg('[' || idx || '] ' || told, chr(10) order by idx)) as n
      from {rows} where size > keep group by job_id, list_no),
    {name}_named as (select job_id, list_no, list_slice(list_filter({picks}, lambda x, i: x < size and list_position({picks}, x) = i), 1, keep) as named
      from {name}_asked where n % 4 <> 0),
    {name} as (select * from (
      select r.*, case when size <= keep then idx when len(named) > 0 then list_position(named, idx) - 1
                       else row_number() over (partition by r.job_id, r.list_no order by confidence desc, idx) - 1 end as pos
      from {rows} r left join {name}_named a on a.job_id = r.job_id and a.list_no = r.list_no) where pos < keep)"""


@query("ranked_shortlist", f"""
    with placed as (
      select m.*, row_number() over (partition by m.job_id order by start_sec, end_sec, m.moment_id) - 1 as nth, count(*) over (partition by m.job_id) as total,
             printf('%.0f', start_sec) || 's: ' || reason || ' | ' || coalesce(excerpt, '') as told
      from merged m left join merged_said s on s.job_id = m.job_id and s.moment_id = m.moment_id),
    one as (select *, nth // 3 as list_no, nth % 3 as idx, least(3, total - nth // 3 * 3) as size,
                   (case when ceil(total / 3e0) = 1 then 2 else greatest(1, ceil(4e0 / ceil(total / 3e0))) end)::bigint as keep from placed where total > 2),
    {_picked_sql('one', 'survived')},
    two as (select * replace (row_number() over (partition by job_id order by list_no, pos) - 1 as idx, 0 as list_no,
                              count(*) over (partition by job_id) as size, 2 as keep) from survived),
    {_picked_sql('(select * exclude (pos) from two)', 'final')}
    select job_id, moment_id, start_sec, end_sec, confidence, nth + 1 as place from placed where total <= 2
    union all select job_id, moment_id, start_sec, end_sec, confidence, pos + 1 from final""")
def ranked_shortlist(t: Tables) -> DataFrame:
    """Short lists, so that most recordings go through both passes."""
    return mo.ranked_shortlist(written(_merged(t)), t.segments, _picking, target=2, batch=3).select(
        "job_id", "moment_id", "start_sec", "end_sec", "confidence", "place")


def _centres(t: Tables) -> DataFrame:
    return t.moments.select(
        "job_id", F.col("moment_id").alias("candidate_id"), "confidence",
        ((F.col("start_sec") + F.col("end_sec")) / 2.0).alias("centre_sec"),
    )


add_view("axes_chat", """
    select m.job_id, moment_id as candidate_id, count(offset_sec) as messages
    from moments m left join chat c on c.job_id = m.job_id
     and offset_sec between (start_sec + end_sec) / 2 - 30 and (start_sec + end_sec) / 2 + 30 group by all""")
add_view("axes_audio", """
    select m.job_id, moment_id as candidate_id, coalesce(round(sum(rms_db::decimal(18, 6))::double / count(rms_db), 6), -99e0) as mean_db
    from moments m left join loudness c on c.job_id = m.job_id and rms_db > -99
     and time_sec between (start_sec + end_sec) / 2 - 30 and (start_sec + end_sec) / 2 + 30 group by all""")


@query("chat_density", "select * from axes_chat")
def chat_density(t: Tables) -> DataFrame:
    return fusion.chat_density(_centres(t), t.chat).select("job_id", "candidate_id", "messages")


@query("audio_mean_loudness", "select * from axes_audio")
def audio_mean_loudness(t: Tables) -> DataFrame:
    return fusion.mean_loudness(_centres(t), t.loudness).select("job_id", "candidate_id", "mean_db")


@query("chat_weight", """
    select job_id, count(*) as messages, least(1e0, count(*) / 500e0) as weight from chat group by job_id""")
def chat_weight(t: Tables) -> DataFrame:
    return t.chat.groupBy("job_id").agg(F.count(F.lit(1)).alias("messages")).select(
        "job_id", "messages", fusion.chat_weight(F.col("messages")).alias("weight")
    )


@query("tie_ranks", """
    select job_id, moment_id, confidence, rank() over (partition by job_id order by confidence desc)
           + (count(*) over (partition by job_id, confidence) - 1) / 2e0 as rank from moments""")
def tie_ranks(t: Tables) -> DataFrame:
    return fusion.tie_ranks(t.moments, ["job_id"], "confidence").select("job_id", "moment_id", "confidence", "rank")


@query("rank_fusion", """
    with axes as (select job_id, moment_id as candidate_id, 'text' as axis, confidence as score, 1e0 as weight from moments
                  union all select a.job_id, candidate_id, 'audio', mean_db, 1e0 from axes_audio a
                    where job_id in (select job_id from loudness)
                  union all select a.job_id, candidate_id, 'chat', messages, w.weight from axes_chat a
                    join (select job_id, least(1e0, count(*) / 500e0) as weight from chat group by job_id) w on w.job_id = a.job_id),
    ranked as (select *, rank() over (partition by job_id, axis order by score desc)
                  + (count(*) over (partition by job_id, axis, score) - 1) / 2e0 as rank from axes)
    select job_id, candidate_id, round(sum(weight * rank), 6) as fused,
           row_number() over (partition by job_id order by round(sum(weight * rank), 6), candidate_id) as place
    from ranked group by job_id, candidate_id""")
def rank_fusion(t: Tables) -> DataFrame:
    centres = _centres(t)
    heard = t.loudness.select("job_id").distinct()
    chatted = t.chat.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))

    def axis(df: DataFrame, name: str, score: str) -> DataFrame:
        return df.select("job_id", "candidate_id", F.lit(name).alias("axis"), F.col(score).cast("double").alias("score"))

    audio = fusion.mean_loudness(centres, t.loudness).join(heard, "job_id", "left_semi")
    chat = fusion.chat_density(centres, t.chat).join(chatted, "job_id", "left_semi")
    scores = axis(centres, "text", "confidence").unionByName(axis(audio, "audio", "mean_db")).unionByName(
        axis(chat, "chat", "messages")
    )
    always = F.explode(F.array(F.lit("text"), F.lit("audio"))).alias("axis")
    weights = centres.select("job_id").distinct().select("job_id", always, F.lit(1.0).alias("weight")).unionByName(
        chatted.select("job_id", F.lit("chat").alias("axis"), fusion.chat_weight(F.col("n")).alias("weight"))
    )
    return fusion.fuse(written(scores), weights)


@query("detector_routing", """
    select job_id, start_sec, end_sec, score, 'answers' as path
    from (select job_id, start_sec, end_sec, confidence as score from merged) where job_id % 3 <> 0
    union all
    select job_id, start_sec, end_sec, score, 'heuristic' from detected
    where job_id % 3 = 0 or job_id not in (select job_id from moments)""")
def detector_routing(t: Tables) -> DataFrame:
    """Jobs without an answer, or whose answers failed, take the heuristic path."""
    from clipstride.plans.detect import detect_routed

    answers = responses(t).withColumn("failed", F.col("job_id") % 3 == 0)
    return detect_routed(t.segments, t.silence, t.loudness, answers, KEYWORDS).select(
        "job_id", "start_sec", "end_sec", "score", "path"
    )


add_view("routed", """
    select m.job_id, m.start_sec, m.end_sec, confidence as score, coalesce(excerpt, '') as excerpt, 'answers' as path
    from merged m left join merged_said s on s.job_id = m.job_id and s.moment_id = m.moment_id where m.job_id % 3 <> 0
    union all
    select job_id, start_sec, end_sec, score, excerpt, 'heuristic' from detected
    where job_id % 3 = 0 or job_id not in (select job_id from moments)""")
add_view("routed_passing", "select * from routed where length(trim(excerpt)) >= 3 and score >= 0.5")
add_greedy("routed_gated", "routed_passing", "score desc, start_sec, end_sec, excerpt, path",
           "abs(k - (x.start_sec + x.end_sec) / 2) <= 45", "(x.start_sec + x.end_sec) / 2")


@query("gated_routing", "select job_id, start_sec, end_sec, score, excerpt, path from routed_gated")
def gated_routing(t: Tables) -> DataFrame:
    """The gate on both paths, the fallback under its request's settings."""
    from clipstride.operators.scoring import DetectorParams
    from clipstride.operators.windows import WindowParams
    from clipstride.plans.detect import detect_routed

    answers = responses(t).withColumn("failed", F.col("job_id") % 3 == 0)
    found = detect_routed(t.segments, t.silence, t.loudness, answers, settings=DetectorParams(WindowParams(keywords=KEYWORDS)), gated=True)
    return found.select("job_id", "start_sec", "end_sec", "score", "excerpt", "path")


@query("expression_fusion", """
    with axes as (select job_id, moment_id as candidate_id, confidence as score, 1e0 as weight from moments
                  union all select job_id, moment_id, start_sec - end_sec, 0.5e0 from moments),
    ranked as (select *, rank() over (partition by job_id, weight order by score desc)
                  + (count(*) over (partition by job_id, weight, score) - 1) / 2e0 as rank from axes)
    select job_id, candidate_id, round(sum(weight * rank), 6) as fused,
           row_number() over (partition by job_id order by round(sum(weight * rank), 6), candidate_id) as place
    from ranked group by job_id, candidate_id""")
def expression_fusion(t: Tables) -> DataFrame:
    """Confident and short moments first, both axes being expressions over one table."""
    candidates = t.moments.withColumnRenamed("moment_id", "candidate_id")
    axes = {"sure": F.col("confidence"), "short": F.col("start_sec") - F.col("end_sec")}
    fused = fusion.fuse_with(candidates, axes, {"sure": 1.0, "short": 0.5})
    return fused.select("job_id", "candidate_id", F.round("fused", 6).alias("fused"), "place")


@query("answered_prompts")
def answered_prompts(t: Tables) -> DataFrame:
    """A model that answers with the length of what it is asked."""
    asked = mo.prompts(t.segments, t.silence, t.loudness, _lengths(t), KEYWORDS)
    return mo.answer(asked, lambda texts: [str(len(x)) for x in texts]).select("job_id", "chunk_no", "raw")


SQL["answered_prompts"] = f"select job_id, chunk_no, length(prompt)::varchar as raw from ({SQL['chunk_prompts']})"
