"""Functions on single rows, readers of text formats, nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.catalog import query
from clipstride.catalog.inputs import KEYWORDS, Tables, add_view, sql_hits
from clipstride.functions import intervals as iv
from clipstride.functions import labels as lb
from clipstride.functions import lifecycle as lc
from clipstride.functions import routing as rt
from clipstride.functions import text as tx
from clipstride.operators import scoring, windows
from clipstride.operators.windows import WindowParams
from clipstride.sources import logs, results


@query("text_functions", f"""
    select doc_id, len(list_filter(string_split_regex(trim(body), '\\s+'), lambda x: x <> '')) as n_words,
           {sql_hits('body')}::bigint as hits, md5(trim(regexp_replace(body, '\\s+', ' ', 'g'))) as squeezed,
           substr(body, 1, 60) as hint
    from (select doc_id, text as body from documents)""")
def text_functions(t: Tables) -> DataFrame:
    docs = t.table("documents").select("doc_id", F.col("text").alias("body"))
    no_words = F.lit(None).cast("array<string>")
    return docs.select(
        "doc_id", tx.word_count(no_words, F.col("body")).cast("long").alias("n_words"),
        tx.emotion_hits(F.col("body"), KEYWORDS).alias("hits"), F.md5(tx.collapse(F.array("body"))).alias("squeezed"),
        tx.head(F.col("body"), tx.HINT_CHARS).alias("hint"),
    )


@query("segment_text", """
    select s.job_id, s.segment_id, coalesce(string_agg(word, ' ' order by pos), '') as said,
           round(greatest(0e0, least(s.end_sec, 21e0) - greatest(s.start_sec, 3.25e0)), 6) as overlap_sec,
           round(case when s.start_sec < 21e0 and s.end_sec > 3.25e0 then
             (least(s.end_sec, 21e0) - greatest(s.start_sec, 3.25e0)) / (greatest(s.end_sec, 21e0) - least(s.start_sec, 3.25e0))
             else 0e0 end, 6) as ratio
    from segments s left join words w on w.job_id = s.job_id and w.segment_id = s.segment_id
     and w.start_sec < 21e0 and w.end_sec > 3.25e0
    group by s.job_id, s.segment_id, s.start_sec, s.end_sec""")
def segment_text(t: Tables) -> DataFrame:
    lo, hi = F.lit(3.25), F.lit(21.0)
    s, e = F.col("start_sec"), F.col("end_sec")
    return t.segments.select(
        "job_id", "segment_id", tx.segment_text(F.col("words"), F.col("text"), lo, hi).alias("said"),
        F.round(iv.overlap(s, e, lo, hi), 6).alias("overlap_sec"), F.round(iv.overlap_ratio(s, e, lo, hi), 6).alias("ratio"),
    )


@query("label_formats", """
    select event_id, case when floor(x / 60) = 0 then floor(x)::bigint || 's'
             else floor(x / 60)::bigint || 'm ' || (floor(x)::bigint % 60) || 's' end as duration,
           case when x >= 3600 then printf('%02d:%02d:%02d.%d', x::bigint // 3600, x::bigint // 60 % 60, x::bigint % 60, 0)
             else printf('%02d:%02d.%d', x::bigint // 60, x::bigint % 60, 0) end as stamp,
           printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) as caption
    from (select event_id, (event_id * 37 % 9000)::double as x, round(value * 100)::bigint as cs from events)""")
def label_formats(t: Tables) -> DataFrame:
    x = (F.col("event_id") * 37 % 9000).cast("double")
    return t.events.select(
        "event_id", lb.duration_label(x).alias("duration"), lb.clip_stamp(x).alias("stamp"),
        lb.caption_time(F.col("value")).alias("caption"),
    )


@query("path_and_enum_normalise", """
    select doc_id, nullif(lower(trim('  ' || lang || ' ')), '') as token,
           lower(trim(source)) in ('download', 'processing', 'export') as valid_role,
           'jobs/' || case when trim(source) = '' then 'job' else regexp_replace(trim(source), '[^a-zA-Z0-9._-]+', '_', 'g') end
             || '/exports/candidate-' || doc_id || '.mp4' as export_key,
           replace('store\\' || source || '\\x', '\\', '/') as path
    from documents""")
def path_and_enum_normalise(t: Tables) -> DataFrame:
    source = F.col("source")
    return t.table("documents").select(
        "doc_id", lc.normalise_token(F.concat(F.lit("  "), F.col("lang"), F.lit(" "))).alias("token"),
        lc.valid_role(source).alias("valid_role"), rt.export_key(source, F.col("doc_id").cast("string")).alias("export_key"),
        rt.normalise_path(F.concat(F.lit("store\\"), source, F.lit("\\x"))).alias("path"),
    )


# Every address as it is, and again with most of them bent, so that every check has something to reject.
add_view("addresses", """
    select page_id, url from pages union all
    select page_id, case page_id % 6 when 0 then '  ' || url || ' ' when 1 then replace(url, 'http', 'ftp')
             when 2 then 'https:///no/host' when 3 then 'https://www.twitch.tv/videos/' || page_id
             when 4 then 'https://cdn.' || page_id || '.example.org/v/clip.' || page_id || '.webm?x=1' else url end as url
    from pages""")


def _addresses(t: Tables) -> DataFrame:
    i, url, name = F.col("page_id") % 6, F.col("url"), F.col("page_id").cast("string")
    pages = t.table("pages").select("page_id", "url")
    return pages.unionByName(pages.select("page_id", (
        F.when(i == 0, F.concat(F.lit("  "), url, F.lit(" "))).when(i == 1, F.replace(url, F.lit("http"), F.lit("ftp")))
        .when(i == 2, "https:///no/host").when(i == 3, F.concat(F.lit("https://www.twitch.tv/videos/"), name))
        .when(i == 4, F.concat(F.lit("https://cdn."), name, F.lit(".example.org/v/clip."), name, F.lit(".webm?x=1")))
        .otherwise(url)
    ).alias("url")))


@query("url_check", """
    select page_id, trim(url) as clean, case when not regexp_matches(lower(trim(url)), '^https?:') then 'scheme'
             when regexp_extract(trim(url), '^[a-z]+://([^/?#]+)', 1) = '' then 'host' end as reject_reason
    from addresses""")
def url_check(t: Tables) -> DataFrame:
    url = F.col("url")
    return _addresses(t).select("page_id", F.trim(url).alias("clean"), rt.reject_reason(url).alias("reject_reason"))


@query("source_routing", """
    select page_id, regexp_matches(host, 'twitch\\.tv|youtube\\.com|youtu\\.be|vimeo\\.com') as platform,
           nullif(regexp_extract(url, 'twitch\\.tv/videos/(\\d+)', 1), '') as vod_id,
           coalesce(nullif(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1), ''), '.mp4') as suffix
    from (select page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) as host,
                 regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from (select page_id, trim(url) as url from addresses))""")
def source_routing(t: Tables) -> DataFrame:
    url = F.trim("url")
    return _addresses(t).select(
        "page_id", rt.needs_platform(url).alias("platform"), rt.vod_id(url).alias("vod_id"),
        rt.file_suffix(url).alias("suffix"),
    )


@query("html_sniff", """
    select page_id, starts_with(lower(ltrim(substr(body, 1, 512))), '<!doctype html')
             or starts_with(lower(ltrim(substr(body, 1, 512))), '<html') as is_html
    from (select page_id, case page_id % 3 when 0 then '  ' || html when 1 then 'RIFF' || html else html end as body from pages)""")
def html_sniff(t: Tables) -> DataFrame:
    i, html = F.col("page_id") % 3, F.col("html")
    body = F.when(i == 0, F.concat(F.lit("  "), html)).when(i == 1, F.concat(F.lit("RIFF"), html)).otherwise(html)
    return t.table("pages").select("page_id", rt.looks_like_html(body).alias("is_html"))


@query("words_json_roundtrip", """
    select s.job_id, s.segment_id, case when s.segment_id % 3 = 1 then 0 else n end as n_words,
           case when s.segment_id % 3 = 1 then null else last_end end as last_end, n = 0 as stored_null
    from (select job_id, segment_id, count(*) as n, max(end_sec) as last_end from words group by all) s""")
def words_json_roundtrip(t: Tables) -> DataFrame:
    stored = t.segments.where(F.size("words") > 0).select(
        "job_id", "segment_id", results.encode_words(F.col("words")).alias("json")
    )
    broken = F.when(F.col("segment_id") % 3 == 1, F.concat(F.lit("{"), F.substring("json", 1, 20))).otherwise(F.col("json"))
    words = results.decode_words(broken)
    return stored.select(
        "job_id", "segment_id", F.size(words).cast("long").alias("n_words"),
        F.try_element_at(words, F.lit(-1))["end_sec"].alias("last_end"), F.col("json").isNull().alias("stored_null"),
    )


# Events as lines of a media tool's log, one log per user.
add_view("log_marks", """
    select user_id as log_id, event_id as line_no, value, event_type,
           case event_type when 'click' then 'start' when 'view' then 'end' end as kind from events""")


def _log(t: Tables) -> DataFrame:
    v, kind = F.col("value").cast("decimal(12,2)").cast("string"), F.col("event_type")
    line = (
        F.when(kind == "click", F.concat(F.lit("[silencedetect @ 0x1] silence_start: "), v))
        .when(kind == "view", F.concat(F.lit("[silencedetect @ 0x1] silence_end: "), v, F.lit(" | silence_duration: "), v))
        .when(kind == "purchase", F.concat(F.lit("lavfi.astats.Overall.RMS_level=-"), v))
        .when(kind == "error", F.lit("lavfi.astats.Overall.RMS_level=-inf"))
        .otherwise(F.concat(F.lit("frame:"), v))
    )
    return t.events.select(F.col("user_id").alias("log_id"), F.col("event_id").alias("line_no"), line.alias("line"))


@query("silence_log_parse", """
    select log_id, start_value as start_sec, value as end_sec, value as duration_sec
    from (select log_id, kind, round(value, 2) as value, lag(kind) over o as before, round(lag(value) over o, 2) as start_value
          from log_marks where kind is not null window o as (partition by log_id order by line_no))
    where kind = 'end' and before = 'start'""")
def silence_log_parse(t: Tables) -> DataFrame:
    return logs.silence_from_log(_log(t))


@query("loudness_log_parse", """
    select user_id as log_id, (row_number() over (partition by user_id order by event_id) - 1) * 0.5e0 as time_sec,
           case when event_type = 'error' then -100e0 else -round(value, 2) end as rms_db
    from events where event_type in ('purchase', 'error')""")
def loudness_log_parse(t: Tables) -> DataFrame:
    return logs.loudness_from_log(_log(t), 0.5)


@query("candidate_json_spellings", """
    select moment_id, case when moment_id % 5 = 4 then 0e0 else start_sec end as start_sec, end_sec,
           case when moment_id % 3 = 0 then 0e0 else confidence end as score from moments""")
def candidate_json_spellings(t: Tables) -> DataFrame:
    i, s = F.col("moment_id"), F.col("start_sec")
    snake = i % 2 == 0
    doc = F.to_json(F.struct(
        F.when(snake & (i % 5 != 4), s).alias("start_sec"), F.when(~snake & (i % 5 != 4), s).alias("startSec"),
        F.when(snake, F.col("end_sec")).alias("end_sec"), F.when(~snake, F.col("end_sec")).alias("endSec"),
        F.when(i % 3 != 0, F.col("confidence")).alias("score"),
    ))
    from clipstride.sources.schemas import CANDIDATES_JSON

    rows = t.moments.select("moment_id", F.from_json(doc, CANDIDATES_JSON).alias("c")).select("moment_id", "c.*")
    return results.coalesce_spellings(rows)


@query("nested_results", """
    select s.job_id as "jobId", part, any_value(duration_sec) as "durationSec",
           count(*) filter (kind = 'segment') as n_segments, count(*) filter (kind = 'silence') as n_silence,
           count(*) filter (kind = 'window') as n_windows, count(*) filter (kind = 'clip') as n_candidates,
           min(start_sec) filter (kind = 'window') as first_window, max(start_sec) filter (kind = 'segment') as last_segment
    from (select job_id, 'segment' as kind, start_sec, floor(start_sec / 60)::bigint as part from segments
          union all select job_id, 'silence', start_sec, floor(start_sec / 60)::bigint from silence
          union all select job_id, 'window', w_start, floor(w_start / 60)::bigint from windows
          union all select job_id, 'clip', start_sec, floor(start_sec / 60)::bigint from moments where job_id in (select job_id from lengths)) s
    join lengths l on l.job_id = s.job_id group by s.job_id, part""")
def nested_results(t: Tables) -> DataFrame:
    scored = scoring.scored_windows(t.segments, t.silence, t.loudness, WindowParams(keywords=KEYWORDS))
    rows = scored.withColumnRenamed("w_start", "start_sec").withColumnRenamed("w_end", "end_sec")
    clips = t.moments.select("job_id", "start_sec", "end_sec", F.col("confidence").alias("score"),
                             F.col("reason").alias("excerpt"))
    docs = results.nested_results(
        t.segments, t.silence, rows, clips, windows.durations(t.segments, t.silence), part_sec=60.0
    )
    return docs.select(
        "jobId", "part", "durationSec", F.size("transcriptSegments").cast("long").alias("n_segments"),
        F.size("silenceSegments").cast("long").alias("n_silence"), F.size("analysisWindows").cast("long").alias("n_windows"),
        F.size("clipCandidates").cast("long").alias("n_candidates"),
        F.try_element_at("analysisWindows", F.lit(1))["startSec"].alias("first_window"),
        F.try_element_at("transcriptSegments", F.lit(-1))["startSec"].alias("last_segment"),
    )
