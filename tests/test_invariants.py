"""Distributed operators against plain loops on random data."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clipstride.functions.intervals import overlap_ratio
from clipstride.operators import evaluation as ev
from clipstride.operators import fusion
from clipstride.operators.greedy import keep_disjoint, keep_spaced
from clipstride.operators.joins import interval_join, points_within
from clipstride.operators.scan import Running, islands, running, time_bucket

random.seed(7)


def spans(n, keys=3, reach=2000.0):
    out = []
    for i in range(n):
        s = round(random.random() * reach, 1)
        out.append((random.randrange(keys), i, s, s + random.choice([0.5, 5.0, 20.0, 90.0]), random.randrange(20) / 20))
    return out


SPAN = "job_id long, id long, s double, e double, score double"


def test_running_equals_one_window_per_key(spark):
    rows = spark.createDataFrame(spans(400), SPAN)
    whole = Window.partitionBy("job_id").orderBy("s", "id").rowsBetween(Window.unboundedPreceding, -1)
    expected = rows.select("id", F.max("e").over(whole).alias("m"), F.coalesce(F.sum("score").over(whole), F.lit(0.0)).alias("t"))
    found = running(rows, ["job_id"], time_bucket(F.col("s"), 50.0), [F.col("s"), F.col("id")],
                    m=Running("max", F.col("e")), t=Running("sum", F.col("score")))
    assert {(r.id, r.m, round(r.t, 6)) for r in found.collect()} == {(r.id, r.m, round(r.t, 6)) for r in expected.collect()}


def test_islands_equal_a_sweep(spark):
    data = spans(300)
    found = {r.id: r.island_start for r in islands(spark.createDataFrame(data, SPAN), ["job_id"], "s", "e", gap=0.6, width=40.0).collect()}
    for job in range(3):
        reach, start = None, None
        for _, i, s, e, _ in sorted((d for d in data if d[0] == job), key=lambda d: (d[2], d[3])):
            if reach is None or s > reach + 0.6:
                start = s
            reach = e if reach is None else max(reach, e)
            assert found[i] == start


def test_interval_join_equals_all_pairs(spark):
    a, b = spans(120), spans(120)
    left = spark.createDataFrame(a, SPAN).withColumnRenamed("id", "left_id").withColumnRenamed("s", "ls").withColumnRenamed("e", "le")
    right = spark.createDataFrame(b, SPAN)
    for closed in (False, True):
        found = interval_join(left, right, ["job_id"], ("ls", "le"), ("s", "e"), width=7.0, closed=closed)
        pairs = [(r.left_id, r.id) for r in found.select("left_id", "id").collect()]
        expected = {(x[1], y[1]) for x in a for y in b if x[0] == y[0]
                    and ((x[2] <= y[3] and y[2] <= x[3]) if closed else (x[2] < y[3] and y[2] < x[3]))}
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_points_within_equals_counting(spark):
    points = [(random.randrange(3), float(random.randrange(500))) for _ in range(600)]
    centres = [(random.randrange(4), i, random.randrange(1000) / 2) for i in range(200)]
    found = points_within(
        spark.createDataFrame(centres, "job_id long, id long, c double"),
        spark.createDataFrame(points, "job_id long, p double"), ["job_id"], "c", "p", 30.0, n=F.lit(1).cast("long"),
    ).collect()
    assert len(found) == len(centres)
    for r in found:
        assert (r.n or 0) == sum(1 for j, p in points if j == r.job_id and r.c - 30 <= p <= r.c + 30)


@pytest.mark.parametrize("strict", [True, False])
def test_keep_spaced_equals_the_greedy_loop(spark, strict):
    data = spans(500, reach=3000.0)
    rows = spark.createDataFrame(data, SPAN)
    kept = keep_spaced(rows, ["job_id"], "s", [(-F.col("score")).alias("r"), F.col("s"), F.col("id")], 30.0, strict=strict, width=100.0)
    expected = set()
    for job in range(3):
        chosen = []
        for d in sorted((d for d in data if d[0] == job), key=lambda d: (-d[4], d[2], d[1])):
            if all((abs(d[2] - k) >= 30) if strict else (abs(d[2] - k) > 30) for k in chosen):
                chosen.append(d[2])
                expected.add(d[1])
    assert {r.id for r in kept.collect()} == expected


def test_keep_disjoint_equals_the_greedy_loop(spark):
    data = spans(400)
    kept = keep_disjoint(
        spark.createDataFrame(data, SPAN), ["job_id"], "s", "e", [(-F.col("score")).alias("r"), F.col("id")],
        lambda k, x: overlap_ratio(k["s"], k["e"], x["s"], x["e"]) >= 0.3,
    )

    def ratio(a, b):
        shared = min(a[3], b[3]) - max(a[2], b[2])
        return shared / (max(a[3], b[3]) - min(a[2], b[2])) if shared > 0 else 0.0

    expected = set()
    for job in range(3):
        chosen = []
        for d in sorted((d for d in data if d[0] == job), key=lambda d: (-d[4], d[1])):
            if all(ratio(d, k) < 0.3 for k in chosen):
                chosen.append(d)
                expected.add(d[1])
    assert {r.id for r in kept.collect()} == expected


def test_label_hits_and_false_positives_equal_nested_loops(spark):
    labels, found = spans(150), spans(80)
    names = ["source", "id", "start_sec", "end_sec", "score"]
    l, c = spark.createDataFrame(labels, SPAN).toDF(*names), spark.createDataFrame(found, SPAN).toDF(*names)

    def inside(label, candidate):
        return label[0] == candidate[0] and candidate[2] - 2 <= (label[2] + label[3]) / 2 <= candidate[3] + 2

    hits = {r.id: r.hit for r in ev.label_hits(l, c, 2.0).collect()}
    assert hits == {x[1]: any(inside(x, y) for y in found) for x in labels}
    false = {r.id: r.false_positive for r in ev.false_positives(c, l, 2.0).collect()}
    assert false == {y[1]: not any(inside(x, y) for x in labels) for y in found}


def test_auc_equals_pairs(spark):
    rows = [(random.randrange(2), random.randrange(30) / 10, random.random() < 0.3) for _ in range(300)]
    for r in ev.auc(spark.createDataFrame(rows, "g long, x double, t boolean"), "x", "t", ["g"]).collect():
        true = [x for g, x, t in rows if g == r.g and t]
        other = [x for g, x, t in rows if g == r.g and not t]
        wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in true for b in other)
        assert r.auc == pytest.approx(wins / (len(true) * len(other)))


def test_fusion_is_a_permutation_and_ties_keep_their_order(spark):
    rows = [(1, i) for i in range(50)]
    pool = spark.createDataFrame(rows, "job_id long, candidate_id long")
    fused = fusion.fuse_with(pool, {"text": F.col("candidate_id") % 5, "audio": F.lit(1.0)}, {"text": 1.0, "audio": 1.0})
    found = sorted((r.place, r.candidate_id) for r in fused.collect())
    assert [p for p, _ in found] == list(range(1, 51))
    assert [c for _, c in found] == sorted(range(50), key=lambda i: (-(i % 5), i))


def test_fusion_refuses_unequal_axes(spark):
    scores = spark.createDataFrame(
        [(1, 1, "text", 0.5), (1, 2, "text", 0.4), (1, 1, "chat", 3.0)],
        "job_id long, candidate_id long, axis string, score double",
    )
    weights = spark.createDataFrame([(1, "text", 1.0)], "job_id long, axis string, weight double")
    with pytest.raises(ValueError):
        fusion.fuse_checked(scores, weights)
    with pytest.raises(ValueError):
        fusion.fuse_checked(scores.limit(0), weights)
