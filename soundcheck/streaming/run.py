"""Run a stream over what is there now, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from soundcheck.session import shared_path


def use_rocksdb(spark: SparkSession) -> None:
    """Custom state and large state need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def timed(stream: DataFrame, delay: str, at_ms: str = "at_ms") -> DataFrame:
    """``stream`` (with ``at_ms``) behind a watermark that moves timers but drops no row.

    Spark drops late rows of an operator that sees the watermarked column. That column is left out here, so the
    operator gets them all and tells the late ones itself.
    """
    columns = stream.columns
    return stream.withColumn("_event_time", F.timestamp_millis(at_ms)).withWatermark("_event_time", delay).select(*columns)


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A file stream. ``files_per_batch`` bounds what one micro-batch takes in."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None,
                  timeout_s: int = 3600) -> DataFrame:
    """Process all available input, append to a parquet table and return the table.

    Table and checkpoint lie in the shared folder unless named; naming them lets a later run go on.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark, label)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint or shared_path(spark, f"{label}-checkpoint"))
             .trigger(availableNow=True).start())
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream {label} did not end within {timeout_s} s")
    return spark.read.schema(stream.schema).parquet(path)
