import pytest
from pyspark.sql import functions as F

from clipstride.functions import labels as lb
from clipstride.functions import lifecycle as lc
from clipstride.functions import responses as rs
from clipstride.functions import routing as rt
from clipstride.functions import text as tx
from clipstride.operators import moments as mo
from clipstride.plans.detect import ask, detect_routed
from clipstride.sources import schemas


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, expected", [
    ('[{"start_sec": 1, "end_sec": 2.5, "reason": "r", "confidence": 0.9}]', [(1.0, 2.5, "r", 0.9)]),
    ('Sure!\n```json\n[{"start": 1, "end": 2}]\n```\nbye', [(1.0, 2.0, "", 0.5)]),
    ('x [{"startSec": "3", "endSec": 4, "score": 7}, 5, "no", {"start_sec": 9, "end_sec": 8}] y', [(3.0, 4.0, "", 1.0)]),
    ('first {"start_sec": 1, "end_sec": 2} then {"start_sec": bad} then {"start_sec": 5, "end_sec": 6}',
     [(1.0, 2.0, "", 0.5), (5.0, 6.0, "", 0.5)]),
    ('[{"start_sec": null, "startSec": 1, "end_sec": 2}]', []),
    ('[{"start_sec": -1, "end_sec": 2}]', []),
    ("[]", []), ("nothing here", []), ("", []),
])
def test_highlights(spark, raw, expected):
    rows = spark.createDataFrame([(1, raw)], "job_id long, raw string")
    found = mo.parse_highlights(rows).orderBy("pos").collect()
    assert [(r.start_sec, r.end_sec, r.reason, r.confidence) for r in found] == expected


def test_index_lists_and_scores(spark):
    assert one(spark, rs.index_list(F.lit("keep [3, 1, 3, 99] of 12"), F.lit(10))) == [3, 1]
    assert one(spark, rs.index_list(F.lit("2 and 4"), F.lit(10))) == [2, 4]
    scores = {"0.8": 0.8, "SCORE: 0.42 yes": 0.42, "85": 0.85, "7": 0.7, "no number": None, "500": 1.0}
    for raw, value in scores.items():
        got = one(spark, rs.model_score(F.lit(raw)))
        assert got == (pytest.approx(value) if value is not None else None)


def test_emotion_hits_know_letters_beyond_ascii(spark):
    assert one(spark, tx.emotion_hits(F.lit("ÉTAIT LA wow! Wow wowza"), ["wow", " "])) == 4
    assert one(spark, tx.emotion_hits(F.lit("a.b axb"), ["a.b"])) == 1
    assert one(spark, tx.emotion_hits(F.lit(""), ["a"])) == 0


def test_labels(spark):
    assert one(spark, lb.caption_time(F.lit(3661.999))) == "1:01:02.00"
    assert one(spark, lb.clip_stamp(F.lit(3725.67))) == "01:02:05.6"
    assert one(spark, lb.clip_stamp(F.lit(65.25))) == "01:05.2"
    assert one(spark, lb.duration_label(F.lit(125.0))) == "2m 5s"
    assert one(spark, lb.elapsed_label(F.lit(0), F.lit(300_000_000))) == "5m"
    word = F.struct(F.lit("hi").alias("word"), F.lit(0.0).alias("start_sec"), F.lit(0.401).alias("end_sec"))
    assert one(spark, lb.karaoke(F.array(word))) == "{\\kf41}hi"


def test_policies_and_phases(spark):
    waits = [one(spark, lc.retry_backoff_sec(F.lit("ANALYZE"), F.lit(n))) for n in (0, 1, 2, 4, 9)]
    assert waits == [30, 30, 60, 240, 300]
    phases = {"EXPORT_FAILED": "failure", "JOB_READY_FOR_REVIEW": "moderation", "EXPORT_STARTED": "export",
              "JOB_QUEUED_FOR_PROCESSING": "processing", "JOB_DOWNLOAD_COMPLETED": "ingest", "X": "system"}
    for kind, phase in phases.items():
        assert one(spark, lc.event_phase(F.lit(kind))) == phase
    assert one(spark, lc.shown_progress(F.lit(140), F.lit("NEW"))) == 100
    assert one(spark, lc.shown_progress(F.lit(None).cast("int"), F.lit("TRANSCRIBING"))) == 48


@pytest.mark.parametrize("url, reason", [
    (" https://a.example/x ", None), ("ftp://a.example", "scheme"), ("https:///x", "host"), ("", "scheme"), (None, "scheme"),
])
def test_url_check(spark, url, reason):
    assert one(spark, rt.reject_reason(F.lit(url).cast("string"))) == reason


def test_routing(spark):
    assert one(spark, rt.vod_id(F.lit("https://www.twitch.tv/videos/123?x"))) == "123"
    assert one(spark, rt.file_suffix(F.lit("https://h/a.b/clip.tar.webm?x=1.mp3"))) == ".webm"
    assert one(spark, rt.file_suffix(F.lit("https://h/a.b/clip"))) == ".mp4"
    assert one(spark, rt.export_key(F.lit(" a b "), F.lit(""))) == "jobs/a_b/exports/candidate-candidate.mp4"


def test_a_users_model_and_the_fallback(spark):
    words = [("hello", 1.0, 2.0), ("there", 2.0, 3.0)]
    segs = spark.createDataFrame([(j, 0, 0.0, 40.0, "hello there", 2, words) for j in (1, 2)], schemas.SEGMENTS)
    quiet = spark.createDataFrame([], schemas.SILENCE)

    def model(prompts):
        return ['[{"start_sec": 1, "end_sec": 3, "confidence": 0.7}]' if "hello" in p else None for p in prompts]

    answers = ask(segs, quiet, None, (), model).where("job_id = 1")
    found = {r.job_id: r for r in detect_routed(segs, quiet, None, answers).where("path = 'answers' or job_id = 2").collect()}
    assert (found[1].excerpt, found[1].path) == ("hello there", "answers")
    assert found[2].path == "heuristic"


def test_an_answer_with_text_behind_its_array_falls_to_loose_objects(spark):
    from pyspark.sql import functions as F

    from clipstride.functions import responses

    one, two = '{"start_sec": 1, "end_sec": 5}', '{"start_sec": 7, "end_sec": 9}'
    cases = [(f"See [1]. [{one}]", 1), (f"[{one}] and [{two}]", 2), (f"[{one}, {two}]", 2), (f"```json\n[{one}]\n``` as asked", 1), (f"[{one}], [{two}]", 2)]
    rows = spark.createDataFrame(cases, "raw string, n int").select("n", F.size(F.filter(responses.highlight_objects(F.col("raw")), lambda o: responses.moment_fields(o).isNotNull())).alias("found"))
    assert all(r.n == r.found for r in rows.collect())


def test_moments_the_ranker_did_not_list_are_out(spark):
    from pyspark.sql import functions as F

    from clipstride.operators import moments as mo

    rows = spark.createDataFrame([(1, i, float(10 * i), 10.0 * i + 5, 0.5, {28: 1, 29: 0}.get(i)) for i in range(30)], "job_id long, moment_id long, start_sec double, end_sec double, confidence double, picked int")
    found = {r.moment_id for r in mo.shortlist(rows, F.col("picked")).collect()}
    assert {28, 29} <= found and not found & set(range(20, 28))


def test_an_endless_span_meets_what_there_is(spark):
    from clipstride.operators.joins import interval_join

    left = spark.createDataFrame([(1, 0.0, 1e12)], "job_id long, a double, b double")
    right = spark.createDataFrame([(1, 10.0 * i, 10.0 * i + 5) for i in range(50)], "job_id long, c double, d double")
    assert interval_join(left, right, ["job_id"], ("a", "b"), ("c", "d")).count() == 50
