"""Running a stream over what is there and reading its output back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipstride.operators.store import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """Keyed state with timers needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def stream_of(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read as a stream of files."""
    path = fresh_path(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def drain(stream: DataFrame) -> DataFrame:
    """Run an append stream until its sources are used up; its output as a table."""
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession)
    (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{path}-progress").start(path).awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, handle) -> None:
    """Run a stream through ``handle(batch, batch_id)`` until its sources are used up."""
    path = fresh_path(stream.sparkSession)
    (
        stream.writeStream.foreachBatch(handle).trigger(availableNow=True)
        .option("checkpointLocation", f"{path}-progress").start().awaitTermination()
    )
