"""Tables of derived data that jobs replace, delete from and export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def job_bucket(buckets: int = BUCKETS) -> Column:
    """Many jobs share a directory, so a table has a bounded number of them."""
    return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")


def write_by_job(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    rows.withColumn("job_bucket", job_bucket(buckets)).write.mode("overwrite").partitionBy("job_bucket").parquet(path)


def read_by_job(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, job_bucket int").parquet(path).drop("job_bucket")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or no rows before its first batch is written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def keys_of(jobs: DataFrame) -> DataFrame:
    """The distinct jobs, to be merged with by sorting: files of ids are small, what a broadcast of them takes in memory is not."""
    return jobs.select("job_id").distinct().hint("merge")


def _files(spark: SparkSession, path: str, numbers: list[int]) -> dict[int, set[str]]:
    """Names of the files of each of these buckets."""
    jvm = spark.sparkContext._jvm
    found = {}
    for n in numbers:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/job_bucket={n}")
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found[n] = {f.getPath().getName() for f in files.listStatus(place)} if files.exists(place) else set()
    return found


def stored_jobs(spark: SparkSession, path: str, schema: str, jobs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What is stored for ``jobs(job_id)``; only the directories that may hold them are read."""
    numbers = [r.job_bucket for r in jobs.select(job_bucket(buckets).alias("job_bucket")).distinct().collect()]  # at most ``buckets``
    stored = read_or_empty(spark, path, f"{schema}, job_bucket int").where(F.col("job_bucket").isin(numbers)).drop("job_bucket")
    return stored.join(keys_of(jobs), "job_id", "left_semi")


def replace_jobs(rows: DataFrame, jobs: DataFrame, path: str, schema: str, buckets: int = BUCKETS, *, within: bool = False) -> None:
    """Replace everything stored for ``jobs(job_id)`` by ``rows``; others stay.

    Rows of other jobs are left out; ``within`` says that there are none, which saves sending all rows to their jobs.
    What is read may be stored at ``path`` itself: its directories are replaced when all of the new rows are written.

    Only the directories that hold the jobs are read and rewritten.  Repeating the
    call gives the same table, so a retried or replayed batch does no harm.
    """
    spark = rows.sparkSession
    ids = keys_of(jobs)
    own = rows.where("job_id is not null") if within else rows.join(ids, "job_id", "left_semi")
    fresh = own.withColumn("job_bucket", job_bucket(buckets))
    stored = read_or_empty(spark, path, f"{schema}, job_bucket int")
    # at most ``buckets``; as literals they prune the scan
    numbers = [r.job_bucket for r in jobs.select(job_bucket(buckets).alias("job_bucket")).distinct().collect()]
    kept = stored.where(F.col("job_bucket").isin(numbers)).join(ids, "job_id", "left_anti")
    before = _files(spark, path, numbers)
    (
        kept.unionByName(fresh.select(*kept.columns)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("job_bucket").parquet(path)
    )
    # A bucket left without rows keeps its directory, whose files are the old ones: it must lose them.
    after = _files(spark, path, numbers)
    _drop_buckets(spark, path, [n for n in numbers if before[n] and before[n] == after[n]])


def _drop_buckets(spark: SparkSession, path: str, emptied: list[int]) -> None:
    """Delete directories of buckets without rows; there are at most ``BUCKETS`` of them."""
    jvm = spark.sparkContext._jvm
    for number in emptied:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/job_bucket={number}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_jobs(deleted: DataFrame, children: dict[str, str], root: str, buckets: int = BUCKETS) -> None:
    """Remove jobs from every child table ``name -> schema`` below ``root``."""
    spark = deleted.sparkSession
    for name, schema in children.items():
        replace_jobs(spark.createDataFrame([], schema), deleted, f"{root}/{name}", schema, buckets)


def write_captions(documents: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Caption documents as text, one directory per clip."""
    documents.select("job_id", "candidate_id", F.regexp_replace("content", "\n$", "").alias("value")).repartition(
        buckets, "job_id", "candidate_id"
    ).write.mode("overwrite").partitionBy("job_id", "candidate_id").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Candidates, scores and nested results for evaluation tools."""
    rows.write.mode("overwrite").json(path)
