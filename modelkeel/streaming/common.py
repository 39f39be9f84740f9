"""Stream sources, triggers and sinks shared by the jobs.

Every job keeps its progress in a checkpoint folder and writes to an idempotent sink, so a
lost executor or a restarted driver repeats a batch without duplicating its output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from modelkeel.session import STATE_STORE, fresh_path

#: Flush cadence of the log and lateness accepted by the windows.
FLUSH = "10 seconds"
LATENESS = "10 minutes"


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, source: str = "parquet", max_bytes: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Stream of the files under ``path``; the limits bound one micro-batch.

    The path is spelled as a pattern that matches only itself, because the file source
    takes a folder or a pattern, and a table may be one file or a folder of files.
    """
    reader = spark.readStream.schema(schema).format(source)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(f"{path[:-1]}[{path[-1]}]")


def topic_stream(spark: SparkSession, bootstrap: str, topic: str, *, max_offsets: int = 1_000_000) -> DataFrame:
    """Stream of a topic in the row shape of the batch reader. Needs the Kafka connector."""
    rows = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_offsets).load()
    )
    return rows.select(
        "partition", "offset", "timestamp", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )


def with_event_time(stream: DataFrame, column: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Event time for watermarks; zone-less timestamps are read in the session zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def use_state_store(spark: SparkSession) -> None:
    """State machines keep their state in the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def drain(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process everything available and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_to_table(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Run an append-mode stream to its end and read its parquet output."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, label)
    drain(stream.writeStream.outputMode("append").format("parquet").option("path", path), f"{path}-checkpoint")
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, process: Callable[[DataFrame, int], None], label: str) -> None:
    path = fresh_path(stream.sparkSession, label)
    drain(stream.writeStream.outputMode("append").foreachBatch(process), f"{path}-checkpoint")
