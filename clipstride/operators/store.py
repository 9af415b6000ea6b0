"""Results that several later steps read are written once to the shared folder.

The folder is the one named by ``spark.checkpoint.dir``; where that is unset, a folder below the session's warehouse,
which driver and executors must share too: a folder of one machine is refused where executors run on others.

What is written here is deleted when the application ends, or at the end of a ``scope`` around work that is complete
by then (a micro-batch, say).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: What the scope of this thread has written; streams handle their batches in threads of their own.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else a folder below the warehouse."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    folder = spark.conf.get("spark.sql.warehouse.dir")
    files, place = _path(spark, folder)
    if files.getUri().getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {place} is one machine's own")
    return f"{folder}/_intermediate"


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fresh_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder, deleted with the scope or the application."""
    path = f"{shared_folder(spark)}/clipstride/{uuid.uuid4().hex}"
    if (own := _scope.get()) is not None:
        own.append(path)
    else:
        files, place = _path(spark, path)
        files.deleteOnExit(place)
    return path


def delete(spark: SparkSession, path: str) -> None:
    files, place = _path(spark, path)
    files.delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was written inside. Nothing that is read later may come from inside."""
    own: list[str] = []
    before = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in own:
            delete(spark, path)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so a lost executor repeats only what follows, and keeps plans
    that use a result several times from computing it several times.
    """
    path = fresh_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
