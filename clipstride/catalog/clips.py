"""Clip words and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.catalog import SQL, query
from clipstride.catalog.inputs import Tables, add_view
from clipstride.operators import captions as cp
from clipstride.operators.store import fresh_path, written
from clipstride.sources import captions, results, schemas, tables


def clips(t: Tables) -> DataFrame:
    """Moments as clips; starts are moved off the word grid by a quarter second."""
    return t.moments.select(
        "job_id", F.col("moment_id").alias("candidate_id"), (F.col("start_sec") + 0.25).alias("clip_start"),
        F.col("end_sec").alias("clip_end"),
    )


add_view("clip_bounds", """
    select job_id, moment_id as candidate_id, start_sec + 0.25e0 as clip_start, end_sec as clip_end from moments""")
add_view("caption_parts", """
    select c.job_id, candidate_id, segment_id, pos, word, greatest(start_sec, clip_start) - clip_start as start_sec,
           least(end_sec, clip_end) - clip_start as end_sec
    from clip_bounds c join words w on w.job_id = c.job_id and w.end_sec > clip_start and w.start_sec < clip_end
    where least(end_sec, clip_end) > greatest(start_sec, clip_start)""")
add_view("caption_groups", """
    select job_id, candidate_id, (n - 1) // 5 as phrase_no, first(start_sec order by n) as start_sec,
           last(end_sec order by n) as end_sec,
           string_agg('{\\kf' || greatest(1, ceil((end_sec - start_sec) * 100)::bigint) || '}' || word, ' ' order by n) as marked,
           string_agg(word, ' ' order by n) as said
    from (select *, row_number() over (partition by job_id, candidate_id order by segment_id, pos) as n from caption_parts)
    group by job_id, candidate_id, (n - 1) // 5""")


def sql_caption_time(x: str) -> str:
    cs = f"round(({x}) * 100)::bigint"
    return f"printf('%d:%02d:%02d.%02d', {cs} // 360000, {cs} // 6000 % 60, {cs} // 100 % 60, {cs} % 100)"


add_view("caption_lines", f"""
    select job_id, candidate_id, phrase_no, 'Dialogue: 0,' || {sql_caption_time('start_sec + 1.5e0')} || ','
           || {sql_caption_time('end_sec + 1.5e0')} || ',Karaoke,,0,0,0,,' || marked as line from caption_groups""")


@query("clip_words", """
    select c.job_id, candidate_id, segment_id, pos, word from clip_bounds c
    join words w on w.job_id = c.job_id and w.start_sec >= clip_start and w.end_sec <= clip_end""")
def clip_words(t: Tables) -> DataFrame:
    return cp.clip_words(clips(t), t.segments).select("job_id", "candidate_id", "segment_id", "pos", "word")


@query("caption_words", """
    select job_id, candidate_id, segment_id, pos, word, round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec
    from caption_parts""")
def caption_words(t: Tables) -> DataFrame:
    return cp.caption_words(clips(t), t.segments).select(
        "job_id", "candidate_id", "segment_id", "pos", "word", F.round("start_sec", 6).alias("start_sec"),
        F.round("end_sec", 6).alias("end_sec"),
    )


@query("caption_phrases", """
    select job_id, candidate_id, phrase_no, round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec, said
    from caption_groups""")
def caption_phrases(t: Tables) -> DataFrame:
    found = cp.phrases(cp.caption_words(clips(t), t.segments))
    return found.select(
        "job_id", "candidate_id", "phrase_no", F.round("start_sec", 6).alias("start_sec"),
        F.round("end_sec", 6).alias("end_sec"),
        F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("said"),
    )


@query("caption_events", "select * from caption_lines")
def caption_events(t: Tables) -> DataFrame:
    return cp.caption_events(cp.phrases(cp.caption_words(clips(t), t.segments)), 1.5)


@query("caption_documents", f"""
    select job_id, candidate_id, '{cp.header(True)}' || string_agg(line, chr(10) order by phrase_no) || chr(10) as content
    from caption_lines group by job_id, candidate_id""")
def caption_documents(t: Tables) -> DataFrame:
    return cp.caption_documents(clips(t), t.segments, vertical=True, time_offset=1.5)


@query("caption_files")
def caption_files(t: Tables) -> DataFrame:
    """Every clip's caption file, written twice and read back: the second write replaces the first."""
    path = fresh_path(t.spark)
    documents = written(caption_documents(t))
    captions.write_caption_files(documents.withColumn("content", F.lit("outdated")), path, 8)
    captions.write_caption_files(documents, path, 8)
    return captions.read_caption_files(t.spark, path)


SQL["caption_files"] = SQL["caption_documents"]


@query("labels_json", """
    select source::varchar as source, start_sec, end_sec, case when label_id % 3 = 0 then '' else 'label ' || label_id end as note from gt_labels""")
def labels_json(t: Tables) -> DataFrame:
    """Labels as JSON files and back; every third has no note."""
    path = fresh_path(t.spark)
    note = F.when(F.col("label_id") % 3 != 0, F.concat(F.lit("label "), F.col("label_id").cast("string")))
    tables.write_json(t.gt_labels.select(F.col("source").cast("string").alias("source"), "start_sec", "end_sec", note.alias("note")), path)
    return results.read_label_lines(t.spark, path)


@query("evaluation_files", """
    select job_id, moment_id, start_sec::double as start_sec, end_sec::double as end_sec, confidence as score from moments""")
def evaluation_files(t: Tables) -> DataFrame:
    """Scored candidates as JSON for evaluation tools, read back from either spelling."""
    path = fresh_path(t.spark)
    later = F.col("moment_id") % 2 == 1
    spelt = {"start_sec": (~later, "start_sec"), "startSec": (later, "start_sec"), "end_sec": (~later, "end_sec"), "endSec": (later, "end_sec")}
    tables.write_json(t.moments.select(
        "job_id", "moment_id", F.col("confidence").alias("score"), *[F.when(when, F.col(c).cast("double")).alias(n) for n, (when, c) in spelt.items()]), path)
    rows = t.spark.read.schema(f"job_id long, moment_id long, {schemas.CANDIDATES_JSON}").json(path)
    return results.coalesce_spellings(rows)
