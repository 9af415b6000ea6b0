"""Caption documents as files, one per clip, written all or not at all.

A write makes a new run below the path, with the files of many clips in each of its bucket directories. Only when every
task has ended does the driver name the run in a file ``current``, which readers follow; an interrupted or repeated
task leaves files that nobody reads. The path is any that Arrow's file systems open (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SHAPE = "job_id long, candidate_id long, content string, job_bucket int"
CURRENT = "current"
#: Names, and whole files, that a task holds at once.
NAMES, FILES = 10_000, 256


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    files: int


class CaptionFiles(DataSource):
    """Format ``caption_files``; rows as in SHAPE."""

    @classmethod
    def name(cls) -> str:
        return "caption_files"

    def schema(self) -> str:
        return SHAPE

    def writer(self, schema, overwrite: bool) -> CaptionWriter:
        return CaptionWriter(self.options["path"], uuid.uuid4().hex)


class CaptionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _opened(self.path)
        made, count = set(), 0
        for batch in iterator:
            for job, clip, content, bucket in zip(*(batch.column(c).to_pylist() for c in ("job_id", "candidate_id", "content", "job_bucket"))):
                folder = f"{root}/{self.run}/{bucket}"
                if folder not in made:
                    files.create_dir(folder)
                    made.add(folder)
                with files.open_output_stream(f"{folder}/{job}_{clip}.ass") as out:
                    out.write(content.encode())
                count += 1
        return Written(count)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        files.create_dir(root)
        with files.open_output_stream(f"{root}/.{self.run}") as out:
            out.write(self.run.encode())
        files.move(f"{root}/.{self.run}", f"{root}/{CURRENT}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        if files.get_file_info(f"{root}/{self.run}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.run}")


def write_caption_files(documents: DataFrame, path: str, buckets: int = 256) -> None:
    """Replace the caption files at ``path`` by those of ``documents(job_id, candidate_id, content)``; clips with null or empty content get none."""
    documents.sparkSession.dataSource.register(CaptionFiles)
    bucket = F.pmod(F.xxhash64("job_id", "candidate_id"), F.lit(buckets)).cast("int")
    rows = documents.where("content <> ''").select(
        F.col("job_id").cast("long"), F.col("candidate_id").cast("long"), "content", bucket.alias("job_bucket"))
    # by clip, not by bucket: buckets may be fewer than the cores that write
    rows.repartition(_tasks(documents.sparkSession), "job_id", "candidate_id").write.format("caption_files").mode("append").save(path)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _named(path: str):
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places and names of the files in bucket directories."""
        files, _ = _opened(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                found = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".ass")]
                for at in range(0, len(found), NAMES):
                    yield pa.RecordBatch.from_arrays([pa.array(found[at : at + NAMES], pa.string())], names=["file"])

    return named


def _read(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(path)
        for batch in batches:
            for at in range(0, len(batch), FILES):
                some = batch.column("file").slice(at, FILES)
                content = []
                for file in some.to_pylist():
                    with files.open_input_stream(file) as opened:
                        content.append(opened.read().decode())
                yield pa.RecordBatch.from_arrays([some, pa.array(content, pa.string())], names=["file", "content"])

    return read


def read_caption_files(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, candidate_id, content) of the last complete write."""
    files, root = _opened(path)
    with files.open_input_stream(f"{root}/{CURRENT}") as named:
        run = named.read().decode()
    folders = [(f.path,) for f in files.get_file_info(fs.FileSelector(f"{root}/{run}", allow_not_found=True)) if f.type == fs.FileType.Directory]
    # Spark's own reader counts a small file as 4 MB, so it has a task for every 32 of them
    named = spark.createDataFrame(folders, "folder string").repartition(max(1, len(folders))).mapInArrow(_named(path), "file string")
    read = named.repartition(_tasks(spark), "file").mapInArrow(_read(path), "file string, content string")
    name = F.regexp_extract("file", r"([^/]+)\.ass$", 1)
    found = read.select(F.split(name, "_").alias("ids"), "content")
    return found.select(F.col("ids")[0].cast("long").alias("job_id"), F.col("ids")[1].cast("long").alias("candidate_id"), "content")
