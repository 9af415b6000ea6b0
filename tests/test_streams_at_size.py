"""Streams that must not grow in the driver, in Python or in passes over their tables."""

import pytest
from pyspark.sql import functions as F

from clipstride.sources import tables
from clipstride.streaming import state
from clipstride.streaming.run import stateful

HOUR = 3_600_000_000
BEATS = "task_id long, task_type string, status string, us long, ts timestamp"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_jobs_are_not_found_by_a_broadcast(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "job_id long, v string"
    rows = spark.createDataFrame([(j, "old") for j in range(20)], schema)
    tables.replace_jobs(rows, rows, path, schema, 4)
    found = tables.stored_jobs(spark, path, schema, spark.createDataFrame([(3,), (3,), (None,), (40,)], "job_id long"), 4)
    assert "SortMergeJoin" in _plan(found) and "Broadcast" not in _plan(found)
    assert [tuple(r) for r in found.collect()] == [(3, "old")]


def test_what_is_replaced_may_be_read_from_the_table_itself(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "job_id long, v string"
    rows = spark.createDataFrame([(j, "old") for j in range(20)], schema)
    tables.replace_jobs(rows, rows, path, schema, 4)
    half = tables.read_by_job(spark, path, schema).where("job_id < 10")
    renewed = half.select("job_id", F.concat("v", F.lit("er")).alias("v")).unionByName(spark.createDataFrame([(None, "lost")], schema))
    tables.replace_jobs(renewed, half, path, schema, 4, within=True)
    found = sorted(tuple(r) for r in tables.read_by_job(spark, path, schema).collect())
    assert found == [(j, "older" if j < 10 else "old") for j in range(20)]


@pytest.mark.parametrize("batches, reported", [
    ([[(1, "RUNNING", 1)], [(9, "SUCCEEDED", 9)]], {(1, HOUR)}),
    ([[(1, "RUNNING", 1)], [(1, "RUNNING", 2)], [(9, "SUCCEEDED", 9)]], {(1, 2 * HOUR)}),
    ([[(1, "RUNNING", 1), (2, "QUEUED", 1)], [(1, "SUCCEEDED", 2)], [(9, "SUCCEEDED", 9)]], set()),
    ([[(1, "CLAIMED", 1)], [(9, "SUCCEEDED", 9)], [(1, "RUNNING", 10)], [(9, "SUCCEEDED", 30)]], {(1, HOUR), (1, 10 * HOUR)}),
    ([[(1, "RUNNING", 1)], [(9, "SUCCEEDED", 3)]], set()),
])
def test_watchdog_reports_a_task_once(spark, tmp_path, batches, reported):
    """A task is heard of for two hours; the state is Spark's, not Python's."""
    stateful(spark)
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for rows in batches:
        beats = [(task, "EXPORT", status, at * HOUR) for task, status, at in rows]
        spark.createDataFrame(beats, "task_id long, task_type string, status string, us long").withColumn(
            "ts", F.timestamp_micros("us")).write.mode("append").parquet(source)
        found = state.watchdog(spark.readStream.schema(BEATS).parquet(source), {"EXPORT": 7200})
        run = found.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", progress).start(out)
        run.awaitTermination()
        assert "Python" not in run._jsq.explainInternal(False)
    got = [(r.task_id, r.last_heartbeat_us) for r in spark.read.schema("task_id long, last_heartbeat_us long").parquet(out).collect()]
    assert sorted(got) == sorted(reported)
