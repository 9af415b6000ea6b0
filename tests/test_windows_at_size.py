"""Windows over more words are more tasks, and what was dealt once is not sent again."""

from pyspark.sql import functions as F

from clipstride.operators import greedy, scoring, windows
from clipstride.operators.scan import ordinal
from clipstride.sources import results, schemas


def test_tasks_of_windows_grow_with_the_words(spark, monkeypatch):
    words = lambda at: [(f"w{i}", at + i, at + i + 0.5) for i in range(10)]
    segs = spark.createDataFrame([(j, k, k * 10.0, k * 10.0 + 10, "x", 10, words(k * 10.0)) for j in range(3) for k in range(9)], schemas.SEGMENTS)
    quiet = spark.createDataFrame([(1, 5.0, 6.0, 1.0)], schemas.SILENCE)
    p = windows.WindowParams(keywords=("w1", "w1 w2"))
    few = sorted(windows.window_metrics(segs, quiet, None, p).collect())
    assert len(few) == 3 * 13 and windows.tasks_for(segs) == 4
    monkeypatch.setattr(windows, "TASK_WORDS", 30)
    assert windows.tasks_for(segs) == 9
    many = windows.window_metrics(segs, quiet, None, p)
    assert many.rdd.getNumPartitions() == 9
    assert sorted(many.collect()) == few
    plan = windows._measure(windows.to_windows(windows.with_runs(windows.place_on_grid(
        windows._sources(segs, quiet, p.keywords), windows.durations(segs, quiet), p, 9), ["job_id", "block"]), p), tasks=9)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" in text


def test_tasks_of_samples_grow_with_the_samples(spark, monkeypatch):
    segs = spark.createDataFrame([(1, 0, 0.0, 300.0, "x", 1, [("w", 0.0, 300.0)])], schemas.SEGMENTS)
    quiet = spark.createDataFrame([(1, 5.0, 6.0, 1.0)], schemas.SILENCE)
    loud = spark.createDataFrame([(1 + k % 3, float(k), -float(k % 50)) for k in range(300)], "job_id long, time_sec double, rms_db double")
    few = sorted(windows.window_metrics(segs, quiet, loud).collect())
    own = [(r.time_sec, r.rms_db) for r in loud.where("job_id = 1").collect()]
    assert len(few) == 55 and all(r.peak_db == max(db for at, db in own if r.w_start <= at < r.w_end) for r in few)
    monkeypatch.setattr(windows, "TASK_WORDS", 30)
    many = windows.window_metrics(segs, quiet, loud)
    text = many._jdf.queryExecution().executedPlan().toString()
    assert many.rdd.getNumPartitions() == 10 and ", 10), REPARTITION_BY_NUM" in text and ", 4), REPARTITION_BY_NUM" in text
    assert sorted(many.collect()) == few


def test_candidates_read_the_words_of_windows_and_clips_once(spark, monkeypatch):
    segs = spark.createDataFrame([(1, 0, 0.0, 90.0, "x", 1, [("of", 0.0, 30.0), ("the", 30.0, 90.0)])], schemas.SEGMENTS)
    quiet = spark.createDataFrame([(1, 5.0, 6.0, 1.0)], schemas.SILENCE)
    loud = spark.createDataFrame([(1, float(k), -float(k % 50)) for k in range(90)], "job_id long, time_sec double, rms_db double")
    calls, spoken = [], windows.spoken_intervals
    monkeypatch.setattr(windows, "spoken_intervals", lambda *a: calls.append(1) or spoken(*a))
    rows = scoring.clip_candidates(segs, quiet, loud, scoring.DetectorParams(windows.WindowParams(keywords=("the", "of the")))).collect()
    assert len(calls) == 1 and rows and all(r.end_sec > r.start_sec for r in rows)


def _scored(spark):
    rows = [(j, k, k * 5.0, k * 5.0 + 30, (k * 7 + j) % 11 / 10) for j in range(3) for k in range(60)]
    return spark.createDataFrame(rows, "job_id long, window_no long, w_start double, w_end double, total_score double")


def test_tasks_that_select_grow_with_the_windows(spark, monkeypatch):
    scored, tasks, written = _scored(spark), [], greedy.written
    monkeypatch.setattr(greedy, "written", lambda df: tasks.append(df.rdd.getNumPartitions()) or written(df))
    for ratio in (0.0, 0.25):
        monkeypatch.setattr(windows, "TASK_WORDS", 100_000)
        few = sorted(scoring.select_non_overlapping(scored, min_overlap_ratio=ratio).collect())
        monkeypatch.setattr(windows, "TASK_WORDS", 20)
        tasks.clear()
        many = sorted(scoring.select_non_overlapping(scored, min_overlap_ratio=ratio).collect())
        assert few == many and len({r.job_id for r in few}) == 3
        assert tasks[0] == 9  # the best row of each place
        if not ratio:
            assert tasks[1] == 9  # what is best within reach
    assert len(scoring.select_non_overlapping(scored, top_n=2).collect()) == 6


def test_no_task_sorts_windows_to_meet_their_extremes(spark):
    metrics = _scored(spark).select(
        "job_id", "window_no", "w_start", "w_end", F.col("total_score").alias("speech_density"), F.lit(0.5).alias("silence_ratio"),
        F.lit(1).cast("long").alias("emotion_hits"), F.lit(0.5).alias("continuity_score"), (-F.col("w_start")).alias("peak_db"))
    scored = scoring.with_score(metrics, scoring.normalisers(metrics))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    assert scored.count() == 180 and scored.where("loudness = 1").count() == 3


def test_tasks_of_nested_results_grow_with_the_words(spark, monkeypatch):
    segs = spark.createDataFrame(
        [(j, k, k * 10.0, k * 10.0 + 10, "x", 10, [(f"w{i}", k * 10.0 + i, k * 10.0 + i + 1) for i in range(10)]) for j in range(3) for k in range(9)],
        schemas.SEGMENTS)
    quiet = spark.createDataFrame([(1, 5.0, 6.0, 1.0)], schemas.SILENCE)
    p = windows.WindowParams()
    rows = scoring.scored_windows(segs, quiet, None, p).withColumnRenamed("w_start", "start_sec").withColumnRenamed("w_end", "end_sec")
    clips = spark.createDataFrame([(0, 1.0, 9.0, 0.5, "a"), (7, 1.0, 9.0, 0.5, "no such job")], "job_id long, start_sec double, end_sec double, score double, excerpt string")

    def docs():
        return results.nested_results(segs, quiet, rows, clips, windows.durations(segs, quiet), 30.0)

    few = sorted(docs().collect())
    assert len(few) == 9 and {r.jobId for r in few} == {0, 1, 2} and sum(len(r.transcriptSegments) for r in few) == 27
    monkeypatch.setattr(windows, "TASK_WORDS", 30)
    plan = docs()._jdf.queryExecution().executedPlan().toString()
    assert ", 9), REPARTITION_BY_NUM" in plan and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(docs().collect()) == few


def test_places_are_counted_in_as_many_tasks_as_asked(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    few = ordinal(rows, ["k"], F.floor(F.col("at") / 50), [F.col("at")], "n")
    many = ordinal(rows, ["k"], F.floor(F.col("at") / 50), [F.col("at")], "n", 9)
    assert many.rdd.getNumPartitions() == 9
    assert sorted(many.collect()) == sorted(few.collect()) and all(r.n == r.at // 3 for r in many.collect())


def test_no_more_tasks_than_rows_are_dealt_to_directly_while_these_stay_small(spark, monkeypatch):
    rows = spark.range(1)
    monkeypatch.setattr(windows, "TASK_WORDS", 10)
    assert [windows.tasks_of(rows, n) for n in (0, 30, 1_500, 2_001, 16_000, 16_001, 80_000)] == [4, 4, 150, 200, 200, 201, 1000]
