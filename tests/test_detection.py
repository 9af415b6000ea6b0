"""Hand-computed detector cases, and inputs that lack something."""

import pytest
from pyspark.sql import functions as F

from clipstride.operators import scoring, snap, windows
from clipstride.operators.windows import WindowParams
from clipstride.sources import schemas

P = WindowParams(window_sec=10.0, step_sec=5.0, keywords=("wow", "oh my"))


def segments(spark, *rows):
    """(job, id, start, end, text, [(word, start, end)])"""
    return spark.createDataFrame(
        [(j, i, s, e, text, len(text.split()), words) for j, i, s, e, text, words in rows], schemas.SEGMENTS
    )


def silence(spark, *rows):
    return spark.createDataFrame([(j, s, e, e - s) for j, s, e in rows], schemas.SILENCE)


def loudness(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.LOUDNESS)


def by_window(df):
    return {(r.job_id, r.window_no): r for r in df.collect()}


def test_windows_end_with_the_recording(spark):
    lengths = spark.createDataFrame([(1, 22.0), (2, 10.0), (3, 4.0), (4, 0.0)], "job_id long, duration_sec double")
    found = windows.sliding_windows(lengths, P).orderBy("job_id", "window_no").collect()
    assert [(r.job_id, r.w_start, r.w_end) for r in found] == [
        (1, 0.0, 10.0), (1, 5.0, 15.0), (1, 10.0, 20.0), (1, 12.0, 22.0), (2, 0.0, 10.0), (3, 0.0, 4.0),
    ]


def test_words_silence_and_pauses(spark):
    words = [("Wow", 0.0, 1.0), ("that", 1.5, 2.0), ("IS", 4.0, 5.0), ("it!", 5.2, 6.0)]
    segs = segments(spark, (1, 0, 0.0, 6.0, "Wow that IS it!", words))
    metrics = by_window(windows.window_metrics(segs, silence(spark, (1, 6.0, 10.0), (1, 8.0, 10.0)), None, P))
    row = metrics[1, 0]
    assert row.speech_density == pytest.approx(0.4)
    assert row.emotion_hits == 3
    assert row.silence_ratio == pytest.approx(0.6)
    assert row.continuity_score == pytest.approx(0.2)
    assert row.peak_db is None


def test_a_window_without_words_of_a_long_segment_hears_nothing(spark):
    segs = segments(spark, (1, 0, 0.0, 40.0, "a b", [("a", 0.0, 1.0), ("b", 38.0, 39.0)]))
    metrics = by_window(windows.window_metrics(segs, silence(spark), None, P))
    assert metrics[1, 2].speech_density == 0.0 and metrics[1, 2].continuity_score == 0.0
    assert metrics[1, 0].speech_density == pytest.approx(0.1)


def test_segments_without_words_count_pro_rata(spark):
    segs = segments(spark, (1, 0, 5.0, 15.0, "wow oh my two three", []), (2, 0, 0.0, 10.0, "x", None))
    metrics = by_window(windows.window_metrics(segs, silence(spark), None, P))
    assert metrics[1, 0].speech_density == pytest.approx(0.25)
    assert metrics[1, 0].emotion_hits == 2
    assert metrics[1, 0].continuity_score == pytest.approx(0.5)
    assert (2, 0) in metrics


def test_phrases_count_only_inside_a_window(spark):
    words = [("oh", 8.0, 9.0), ("my", 9.5, 10.5), ("oh", 10.5, 11.0), ("my", 11.0, 11.5)]
    segs = segments(spark, (1, 0, 0.0, 20.0, "oh my oh my", words))
    metrics = by_window(windows.window_metrics(segs, silence(spark), None, P))
    assert [metrics[1, n].emotion_hits for n in range(3)] == [1, 2, 1]


def test_runs_across_blocks_equal_runs_inside_a_window(spark):
    words = [(f"w{i}", i * 0.5, i * 0.5 + 0.4) for i in range(1500)]
    segs = segments(spark, (1, 0, 0.0, 750.0, "x", words))
    rows = windows.window_metrics(segs, silence(spark), None, P).collect()
    assert len(rows) == 149
    middle = [r.continuity_score for r in rows if 0 < r.window_no < 147]
    assert min(middle) > 0.98


def test_scores_with_and_without_loudness(spark):
    segs = segments(spark, (1, 0, 0.0, 10.0, "x", [("WOW", 0.0, 5.0)]))
    quiet = silence(spark, (1, 5.0, 20.0))
    plain = by_window(scoring.scored_windows(segs, quiet, None, P))
    assert plain[1, 0].total_score == pytest.approx(0.35 + 0.25 * 0.5 + 0.20 + 0.20 * 0.5)
    heard = by_window(scoring.scored_windows(segs, quiet, loudness(spark, (1, 2.0, -10.0), (1, 12.0, -30.0)), P))
    assert heard[1, 0].total_score == pytest.approx(0.45 + 0.20 + 0.20 * 0.5 + 0.15 * 0.5)
    assert heard[1, 2].loudness == 0.0
    one = by_window(scoring.scored_windows(segs, quiet, loudness(spark, (1, 2.0, -10.0)), P))
    assert one[1, 0].loudness == 1.0 and one[1, 2].loudness == 0.0


def test_start_moves_to_the_peak_and_is_scored_again(spark):
    words = [("quiet", 1.0, 2.0), ("then", 11.7, 12.4), ("WOW", 13.0, 14.0), ("WOW", 20.0, 21.0)]
    segs = segments(spark, (1, 0, 0.0, 30.0, "x", words))
    levels = loudness(spark, (1, 2.0, -40.0), (1, 13.0, -5.0), (1, 25.0, -20.0))
    p = scoring.DetectorParams(WindowParams(keywords=("wow",)))
    clip, = scoring.clip_candidates(segs, silence(spark), levels, p).collect()
    assert (clip.start_sec, clip.end_sec) == (12.4, 30.0)
    assert clip.excerpt == "WOW WOW"
    window, = scoring.scored_windows(segs, silence(spark), levels, p.windows).collect()
    assert clip.score != window.total_score


def test_snap_takes_the_first_of_equally_near_edges_and_looks_beyond_the_radius(spark):
    segs = segments(spark, (1, 0, 0.0, 9.0, "x", [("a", 0.0, 4.0), ("b", 6.0, 9.0)]))
    targets = spark.createDataFrame([(1, 5.0), (1, 7.5), (1, 20.0)], "job_id long, target_sec double")
    found = {r.target_sec: r.snapped_sec for r in snap.nearest_boundary(targets, segs, silence(spark)).collect()}
    assert found == {5.0: 4.0, 7.5: 6.0, 20.0: 20.0}


def test_equal_candidates_leave_one(spark):
    rows = [(1, 0.0, 10.0, 0.9, "abc"), (1, 0.0, 10.0, 0.9, "abc"), (1, 45.0, 55.0, 0.8, "abc"), (1, 46.0, 56.0, 0.7, "ab ")]
    pool = spark.createDataFrame(rows, "job_id long, start_sec double, end_sec double, score double, excerpt string")
    kept = scoring.temporal_nms(pool).orderBy("start_sec").collect()
    assert [(r.start_sec, r.score) for r in kept] == [(0.0, 0.9), (46.0, 0.7)]
    assert scoring.candidate_gate(pool).count() == 1
    assert scoring.temporal_nms(pool, 0.0).count() == 4


def test_nothing_to_detect(spark):
    found = scoring.clip_candidates(segments(spark), silence(spark), loudness(spark))
    assert found.count() == 0
    scored = scoring.scored_windows(segments(spark, (1, 0, 0.0, 5.0, "a", [])), silence(spark), None)
    assert scoring.select_non_overlapping(scored, top_n=0).count() == 0
    assert scored.select(F.count("*")).first()[0] == 1


def test_given_lengths_win_where_they_are_given(spark):
    segs = segments(spark, (1, 0, 0.0, 40.0, "a", []), (2, 0, 0.0, 40.0, "a", []), (3, 0, 0.0, 40.0, "a", []))
    given = spark.createDataFrame([(1, 12.5), (2, None), (3, -4.0)], "job_id long, duration_sec double")
    found = {r.job_id: r.duration_sec for r in windows.durations(segs, silence(spark), given).collect()}
    assert found == {1: 12.5, 2: 40.0, 3: 0.0}
