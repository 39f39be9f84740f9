"""Micro-batched append of prediction records to the partitioned log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from modelkeel.sources.records import LOG_PARTITIONS, with_log_partitions
from modelkeel.streaming.common import FLUSH


def log_writer(records: DataFrame, path: str) -> DataStreamWriter:
    """JSON lines below ``use_case=/model=/date=``; the sink commits each batch once.

    Records keep the partitioning of the source, so a busy model is written by all tasks.
    """
    return (
        with_log_partitions(records).writeStream.outputMode("append").format("json")
        .partitionBy(*LOG_PARTITIONS).option("path", path)
    )


def start_log(records: DataFrame, path: str, checkpoint: str, flush: str = FLUSH) -> StreamingQuery:
    return log_writer(records, path).option("checkpointLocation", checkpoint).trigger(processingTime=flush).start()
