"""Spans, values and chains that are spread very unevenly, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from clipstride.functions.intervals import overlap_ratio
from clipstride.operators import evaluation as ev
from clipstride.operators import fusion, greedy, scan
from clipstride.operators import moments as mo
from clipstride.operators.greedy import keep_disjoint, keep_spaced
from clipstride.operators.joins import interval_join


def spans(draw, n, lengths):
    return [(draw.randrange(3), i, float(s := draw.randrange(-200, 3000)), s + draw.choice(lengths)) for i in range(n)]


@pytest.mark.parametrize("closed", [False, True])
def test_spans_of_all_lengths_meet_once(spark, closed):
    draw = random.Random(5)
    left = spans(draw, 250, [0.0, 1.0, 5.0, 40.0, 400.0, 1e12, float("inf")]) + [(1, 900, None, 5.0), (1, 901, 5.0, None)]
    right = spans(draw, 250, [0.0, 2.0, 30.0, 900.0, 1e9]) + [(0, 999, float("-inf"), 5.0)]
    found = interval_join(
        spark.createDataFrame(left, "job_id long, li long, ls double, le double"), spark.createDataFrame(right, "job_id long, ri long, rs double, re double"),
        ["job_id"], ("ls", "le"), ("rs", "re"), width=7.0, closed=closed).collect()
    want = {(a[1], b[1]) for a in left[:250] for b in right if a[0] == b[0]
            and ((a[2] <= b[3] and b[2] <= a[3]) if closed else (a[2] < b[3] and b[2] < a[3]))}
    assert len(found) == len(want) and {(r.li, r.ri) for r in found} == want


def test_an_endless_span_of_one_job_does_not_lengthen_another(spark):
    left = spark.createDataFrame([(1, 0.0, 1e12)] + [(2, 10.0 * i, 10.0 * i + 5) for i in range(50)], "job_id long, a double, b double")
    right = spark.createDataFrame([(1, 10.0 * i, 10.0 * i + 5) for i in range(50)] + [(2, 3.0, 1e12)], "job_id long, c double, d double")
    assert interval_join(left, right, ["job_id"], ("a", "b"), ("c", "d")).count() == 100


def greedy_loop(rows, conflict):
    kept = []
    for row in sorted(rows, key=lambda r: r[-1]):
        if not any(conflict(k, row) for k in kept):
            kept.append(row)
    return {r[0] for r in kept}


@pytest.mark.parametrize("scores", ["equal", "falling", "rising", "mixed"])
@pytest.mark.parametrize("inputs", [10, 0])
def test_chains_of_overlaps(spark, monkeypatch, scores, inputs):
    """Each moment conflicts with its neighbours; with few inputs wider and wider blocks must do."""
    monkeypatch.setattr(greedy, "INPUTS", inputs)
    draw = random.Random(7)
    n = 400
    value = {"equal": lambda i: 0.5, "falling": lambda i: 1 - i / n, "rising": lambda i: i / n, "mixed": lambda i: draw.choice([0.1, 0.5, 0.5, draw.random()])}[scores]
    data = [(1, i, 10.0 * i, 10.0 * i + draw.choice([15.0, 25.0]), value(i)) for i in range(n)]
    rows = spark.createDataFrame(data, "job_id long, moment_id long, start_sec double, end_sec double, confidence double")
    order = [(d[1], d[2], d[3], (-d[4], d[1])) for d in data]

    def ratio(a, b):
        shared = min(a[2], b[2]) - max(a[1], b[1])
        return shared / (max(a[2], b[2]) - min(a[1], b[1])) if shared > 0 else 0.0

    kept = keep_disjoint(rows, ["job_id"], "start_sec", "end_sec", [(-F.col("confidence")).alias("r"), F.col("moment_id")],
                         lambda k, x: overlap_ratio(k["s"], k["e"], x["s"], x["e"]) >= 0.1, width=120.0)
    assert {r.moment_id for r in kept.collect()} == greedy_loop(order, lambda a, b: ratio(a, b) >= 0.1)
    kept = keep_spaced(rows, ["job_id"], "start_sec", [(-F.col("confidence")).alias("r"), F.col("moment_id")], 45.0, strict=False, width=100.0)
    assert {r.moment_id for r in kept.collect()} == greedy_loop(order, lambda a, b: abs(a[1] - b[1]) <= 45.0)


def test_a_long_recording_is_settled_by_many_tasks(spark, monkeypatch):
    """200,000 chained moments of one recording and of equal confidence: no block sees more than its own."""
    n, sizes = 200_000, spark.sparkContext.accumulator(0)
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("job_id"), F.col("id").alias("moment_id"), (F.col("id") * 10.0).alias("start_sec"), (F.col("id") * 10.0 + 18.0).alias("end_sec"),
        F.lit(0.5).alias("confidence"))
    whole = greedy._fates

    def counted(nodes, pairs):
        if len(nodes) > 100:
            sizes.add(1)
        return whole(nodes, pairs)

    monkeypatch.setattr(greedy, "_fates", counted)
    kept = mo.merge_moments(rows, ["moment_id"], ratio=0.2)
    assert kept.agg(F.count("*"), F.sum(F.col("moment_id") % 2)).first() == (n // 2, 0)
    assert sizes.value == 0


@pytest.mark.parametrize("shape", ["outlier", "steps", "even"])
def test_slots_hold_about_as_many_rows_each(spark, monkeypatch, shape):
    monkeypatch.setattr(scan, "UNCUT", 1000)
    value = {"outlier": F.when(F.col("id") == 0, 1e15).otherwise(F.col("id") / 1e6), "steps": F.exp(F.col("id") % 700), "even": F.col("id").cast("double")}[shape]
    rows = spark.range(20_000).select(value.alias("x"), F.lit("k").alias("k")).distinct()
    for keys in (["k"], []):
        cut = scan.by_value(rows, keys, "x", descending=shape == "even")
        sizes = [r["n"] for r in cut.groupBy("_slot").agg(F.count("*").alias("n")).collect()]
        if shape != "steps":  # 700 values are not cut
            assert len(sizes) > 200 and max(sizes) < 2 * sum(sizes) / len(sizes)
        seen = cut.orderBy("x").select("_slot").toPandas()["_slot"]
        assert seen.is_monotonic_decreasing if shape == "even" else seen.is_monotonic_increasing


def test_whole_table_auc_and_ranks_over_slots(spark, monkeypatch):
    monkeypatch.setattr(scan, "UNCUT", 20)
    draw = random.Random(9)
    rows = [(draw.choice([None, draw.randrange(80) / 7, 1e12 * draw.random()]), draw.random() < 0.4) for _ in range(600)]
    (found,) = ev.auc(spark.createDataFrame(rows, "x double, t boolean"), "x", "t").collect()
    true, other = ([x for x, t in rows if t == flag and x is not None] for flag in (True, False))
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in true for b in other)
    assert (found.positives, found.negatives) == (len(true), len(other)) and found.auc == pytest.approx(wins / (len(true) * len(other)))
    ranks = fusion.tie_ranks(spark.createDataFrame([(1, i, x) for i, (x, _) in enumerate(rows)], "job_id long, id long, score double"), ["job_id"]).collect()
    values = sorted((x for x, _ in rows if x is not None), reverse=True)
    assert len(ranks) == len(values)
    for r in ranks:
        places = [i + 1 for i, v in enumerate(values) if v == r.score]
        assert r["rank"] == sum(places) / len(places)


def test_rows_without_a_score_do_not_push_others_back(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 0.9), (1, 3, 0.1)], "job_id long, candidate_id long, score double")
    assert {r.candidate_id: r["rank"] for r in fusion.tie_ranks(rows, ["job_id"]).collect()} == {2: 1.0, 3: 2.0}
    both = rows.withColumn("axis", F.lit("a")).unionByName(rows.na.fill(0.5).withColumn("axis", F.lit("b")))
    with pytest.raises(ValueError, match="same candidates"):
        fusion.fuse_checked(both, spark.createDataFrame([(1, "a", 1.0)], "job_id long, axis string, weight double"))
