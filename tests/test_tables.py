"""Files in and out, replacing and deleting jobs, lifecycle cases."""

import json

import pytest
from pyspark.sql import functions as F

from clipstride.operators import captions as cp
from clipstride.operators import events as ev
from clipstride.operators import lifecycle as op
from clipstride.sources import logs, results, schemas, tables


def test_replacing_jobs_is_exact_and_repeatable(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "job_id long, v string"
    first = spark.createDataFrame([(j, "old") for j in range(20)], schema)
    tables.replace_jobs(first, first, path, schema, 4)
    fresh = spark.createDataFrame([(3, "new"), (3, "more")], schema)
    jobs = spark.createDataFrame([(3,), (4,)], "job_id long")
    for _ in range(2):
        tables.replace_jobs(fresh, jobs, path, schema, 4)
        rows = sorted((r.job_id, r.v) for r in tables.read_by_job(spark, path, schema).collect())
        assert rows == sorted([(j, "old") for j in range(20) if j not in (3, 4)] + [(3, "new"), (3, "more")])
    tables.delete_jobs(spark.range(20).toDF("job_id"), {"t": schema}, str(tmp_path), 4)
    assert tables.read_by_job(spark, path, schema).count() == 0


def test_frozen_input_comes_back_unchanged(spark, tmp_path):
    words = [("a", 0.1, 0.2)]
    request = results.Request(
        spark.createDataFrame([(1, 0, 0.0, 1.0, "a", 1, words), (1, 1, 1.0, 2.0, "", 0, [])], schemas.SEGMENTS),
        spark.createDataFrame([(1, 0.0, 0.5, 0.5)], schemas.SILENCE),
        spark.createDataFrame([], schemas.LOUDNESS),
        spark.createDataFrame([(1, None, None, 2.0, None, None, ["x"])], results.PARAMS),
    )
    results.freeze(request, str(tmp_path / "r"))
    back = results.replay(spark, str(tmp_path / "r"))
    assert back.segments.orderBy("segment_id").collect() == request.segments.orderBy("segment_id").collect()
    assert back.silence.collect() == request.silence.collect() and back.loudness.count() == 0
    assert tuple(back.params.first())[1:6] == (None, 30.0, 2.0, None, 0.0)


def test_results_survive_nesting(spark, tmp_path):
    segs = spark.createDataFrame(
        [(1, i, i * 100.0, i * 100.0 + 5, f"t{i}", 1, [("w", i * 100.0, i * 100.0 + 1)]) for i in range(15)], schemas.SEGMENTS)
    quiet = spark.createDataFrame([(1, 5.0, 6.0, 1.0)], schemas.SILENCE)
    wins = spark.createDataFrame([(1, 0.0, 30.0, 0.1, 0.2, 3, 0.4, 0.5)],
                                 "job_id long, start_sec double, end_sec double, speech_density double, silence_ratio double, "
                                 "emotion_hits long, continuity_score double, total_score double")
    clips = spark.createDataFrame([(1, 0.0, 30.0, 0.5, "e")], "job_id long, start_sec double, end_sec double, score double, excerpt string")
    lengths = spark.createDataFrame([(1, 1500.0)], "job_id long, duration_sec double")
    tables.write_json(results.nested_results(segs, quiet, wins, clips, lengths), str(tmp_path / "j"))
    back = results.result_tables(results.read_results(spark, str(tmp_path / "j")))
    same = ["job_id", "start_sec", "end_sec", "text", "word_count", "words"]
    assert sorted(back["segments"].select(same).collect()) == sorted(segs.select(same).collect())
    for name, df in {"silence": quiet, "windows": wins, "candidates": clips}.items():
        assert back[name].select(df.columns).collect() == df.collect()


def test_labels_candidates_and_words(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"source": "a", "start_sec": 1, "end_sec": 2.5}]))
    assert tuple(results.read_labels(spark, str(tmp_path / "l.json")).first()) == ("a", 1.0, 2.5, "")
    (tmp_path / "c.json").write_text(json.dumps([{"startSec": 1, "end_sec": 2}, {"score": 0.5}]))
    rows = sorted(tuple(r) for r in results.read_candidates(spark, str(tmp_path / "c.json")).collect())
    assert rows == [(0.0, 0.0, 0.5), (1.0, 2.0, 0.0)]
    for stored, size in ((None, 0), (" ", 0), ("{broken", 0), ('[{"word":"a","startSec":1,"endSec":2}]', 1)):
        df = spark.createDataFrame([(stored,)], "j string").select(results.decode_words(F.col("j")).alias("w"))
        assert len(df.first().w) == size


def test_log_lines(spark):
    text = ["silence_end: 1 | silence_duration: 1", "silence_start: 2", "x", "silence_start: 3.5", "silence_end: 5 | silence_duration: 1.5",
            "silence_end: 6 | silence_duration: 1", "lavfi.astats.Overall.RMS_level=-25.43", "frame:1", "lavfi.astats.Overall.RMS_level=-inf"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], schemas.LOG_LINES)
    assert [tuple(r) for r in logs.silence_from_log(lines).collect()] == [(1, 3.5, 5.0, 1.5)]
    levels = logs.loudness_from_log(lines, 0.0).orderBy("time_sec").collect()
    assert [tuple(r) for r in levels] == [(1, 0.0, -25.43), (1, 0.1, -100.0)]


def test_captions(spark, tmp_path):
    words = [(f"w{i}", float(i), i + 1.0) for i in range(8)]
    segs = spark.createDataFrame([(1, 0, 0.0, 8.0, "x", 8, words)], schemas.SEGMENTS)
    clips = spark.createDataFrame([(1, 7, 0.5, 6.5), (1, 8, 90.0, 95.0)], "job_id long, candidate_id long, clip_start double, clip_end double")
    docs = cp.caption_documents(clips, segs).collect()
    assert [d.candidate_id for d in docs] == [7]
    lines = docs[0].content.splitlines()
    assert lines[-2].startswith("Dialogue: 0,0:00:00.00,0:00:04.50,Karaoke,,0,0,0,,{\\kf50}w0 {\\kf100}w1")
    assert lines[-1].endswith("{\\kf100}w5 {\\kf50}w6") and ",40,40,200,1" in docs[0].content
    assert [r.word for r in cp.clip_words(clips, segs).orderBy("pos").collect()] == ["w1", "w2", "w3", "w4", "w5"]
    tables.write_captions(cp.caption_documents(clips, segs), str(tmp_path / "ass"), 2)
    part, = (tmp_path / "ass" / "job_id=1" / "candidate_id=7").glob("part-*")
    assert part.read_text() == docs[0].content


def test_pages_past_the_end_show_the_last(spark):
    pool = spark.createDataFrame([(1, i, i / 10, 0.0) for i in range(5)], "job_id long, candidate_id long, score double, start_sec double")
    rows = op.candidate_page(pool, page=9, size=2).collect()
    assert [(r.candidate_id, r.page, r.total_pages, r.has_next) for r in rows] == [(0, 3, 3, False)]


def test_throttle(spark):
    rows = [(1, 0, 0, "A", 1, "m"), (1, 1, 10, "A", 2, "m"), (1, 2, 100, "A", 1, "m"), (1, 3, 110, "A", 2, "m"),
            (1, 4, 115, "B", 2, "m"), (1, 5, 300, "B", 2, "m"), (1, 6, 301, "A", 2, "m")]
    updates = spark.createDataFrame(rows, "job_id long, event_id long, us long, stage string, percent long, message string")
    sent = ev.throttle_progress(updates, interval_us=100).orderBy("event_id").collect()
    assert [r.event_id for r in sent] == [0, 3, 4, 6]


def test_throttle_with_unknown_percent(spark):
    rows = [(1, i, 200 * i, "A", p, "m") for i, p in enumerate([None, None, 3, None, None])]
    updates = spark.createDataFrame(rows, "job_id long, event_id long, us long, stage string, percent long, message string")
    assert sorted(r.event_id for r in ev.throttle_progress(updates, interval_us=100).collect()) == [0, 2, 3]


def test_caption_files_are_written_whole_or_not_at_all(spark, tmp_path):
    from clipstride.sources import captions

    path = str(tmp_path / "captions")
    clips = spark.createDataFrame([(-1, 2, "é\n\nx"), (-1, 3, "b"), (5, 2, ""), (6, 1, None)], "job_id long, candidate_id long, content string")
    captions.write_caption_files(clips, path, 2)
    want = {(-1, 2, "é\n\nx"), (-1, 3, "b")}
    assert {tuple(r) for r in captions.read_caption_files(spark, path).collect()} == want
    broken = clips.withColumn("content", F.when(F.col("candidate_id") == 3, F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        captions.write_caption_files(broken, path, 2)
    assert {tuple(r) for r in captions.read_caption_files(spark, path).collect()} == want


def test_many_caption_files_are_few_tasks(spark, tmp_path):
    from clipstride.sources import captions

    path = str(tmp_path / "captions")
    clips = spark.range(300).selectExpr("id % 7 as job_id", "id as candidate_id", "concat('c', id, '\n') as content")
    captions.write_caption_files(clips, path, 2)
    read = captions.read_caption_files(spark, path)
    assert read.rdd.getNumPartitions() == 4
    assert {tuple(r) for r in read.collect()} == {(i % 7, i, f"c{i}\n") for i in range(300)}


def test_keyed_state_ends(spark, tmp_path):
    """A mark is remembered over batches, and no longer than it should be by the stream's own time."""
    from clipstride.streaming import state
    from clipstride.streaming.run import stateful

    stateful(spark)
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    shape = "job_id long, event_id long, us long, value long"
    hour = 3_600_000_000
    kept = []
    for n, rows in enumerate([[(1, 1, hour, 5), (2, 2, hour, 7)], [(1, 3, 2 * hour, 4), (3, 4, 9 * hour, 1)], [(3, 5, 10 * hour, 2)], [(1, 6, 11 * hour, 3)]]):
        spark.createDataFrame(rows, shape).write.mode("append").parquet(source)
        marks = state.high_water_mark(spark.readStream.schema(shape).parquet(source), keep_sec=3 * 3600.0, lateness="1 minute")
        run = marks.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", progress).start(out)
        run.awaitTermination()
        kept.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert {r.event_id for r in spark.read.parquet(out).collect()} == {1, 2, 4, 5, 6}  # 3 is below the mark of 1, 6 comes after its end
    assert min(kept) < max(kept)


def test_scopes_of_two_threads_do_not_meet(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from clipstride.operators.store import scope, written

    barrier = Barrier(2)

    def work(n: int) -> int:
        with scope(spark):
            rows = written(spark.range(n))
            barrier.wait()
            if n == 1:
                return rows.count()
            barrier.wait()
            return rows.count()

    with ThreadPoolExecutor(2) as pool:
        first, second = pool.submit(work, 1), pool.submit(work, 5)
        assert first.result() == 1
        barrier.wait()
        assert second.result() == 5
