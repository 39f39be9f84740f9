"""The prediction record: schemas, day keys and the JSON-lines log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeel.schema import columns

#: Fields every record carries besides the features.
ENVELOPE = ("ts", "request_id", "model", "model_version", "prediction", "score", "source")


def record_schema(features: Mapping[str, str], prediction: str = "string") -> T.StructType:
    """Explicit schema of a record with the given feature columns (name → type)."""
    return columns(
        ts="timestamp", request_id="string", **features, model="string", model_version="string",
        prediction=prediction, score="double", source="string",
    )


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """JSON lines under an explicit schema; blank lines vanish, absent keys are null."""
    return spark.read.schema(schema).json(list(paths) if not isinstance(paths, str) else paths)


def day_key(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def file_stamp(ts: Column | str) -> Column:
    return F.date_format(ts, "HHmmssSSSSSS")


def with_log_partitions(records: DataFrame, use_case: Column | str | None = None) -> DataFrame:
    """Add the partition columns of the log: ``use_case`` (unless present) and ``date``."""
    tagged = records if use_case is None else records.withColumn(
        "use_case", F.lit(use_case) if isinstance(use_case, str) else use_case
    )
    return tagged.withColumn("date", day_key("ts"))


LOG_PARTITIONS = ("use_case", "model", "date")


def append_log(records: DataFrame, path: str, *, rows_per_file: int = 2_000_000) -> None:
    """Append records as JSON lines below ``use_case=/model=/date=`` folders.

    The rows are rebalanced by folder first: AQE merges the small folders into one task and
    splits a folder that holds a large share of the rows, so there are neither many tiny
    files nor one long task.
    """
    (
        records.hint("rebalance", *LOG_PARTITIONS).write.mode("append")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*LOG_PARTITIONS)
        .json(path)
    )


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The log with its partition columns as strings, so day filters prune folders."""
    parts = T.StructType([T.StructField(p, T.StringType()) for p in LOG_PARTITIONS])
    names = set(LOG_PARTITIONS)
    body = [f for f in schema.fields if f.name not in names]
    return spark.read.schema(T.StructType([*body, *parts.fields])).json(path)


def log_window(log: DataFrame, since: Column) -> DataFrame:
    """Records at or after ``since``; the day predicate prunes partitions first."""
    return log.filter((F.col("date") >= day_key(since)) & (F.col("ts") >= since))
