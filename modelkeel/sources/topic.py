"""Topic windows and topic records (Kafka row shape)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeel.schema import columns

#: Row shape of the source: partition, offset, timestamp, key, value.
TOPIC_ROW = columns(partition="integer", offset="long", timestamp="timestamp", key="string", value="string")
DEFAULT_TOPIC = "predictions"


def window_options(bootstrap: str, topic: str, since_millis: int) -> dict[str, str]:
    """Batch read options: from a point in time to the marks current at planning time.

    ``latest`` as the no-match strategy makes a partition without newer rows empty.
    """
    return {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingTimestamp": str(since_millis),
        "startingOffsetsByTimestampStrategy": "latest",
        "endingOffsets": "latest",
    }


def read_topic_window(spark: SparkSession, bootstrap: str, topic: str, since_millis: int) -> DataFrame:
    """Topic rows since a bound. Needs the Kafka connector on the class path."""
    rows = spark.read.format("kafka").options(**window_options(bootstrap, topic, since_millis)).load()
    return rows.select(
        "partition", "offset", "timestamp",
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
    )


def decode_window(
    rows: DataFrame, schema: T.StructType, since: Column, *, model: str | None = None,
    high_marks: DataFrame | None = None,
) -> DataFrame:
    """Decode topic rows into records: from ``since`` on, below each high mark, one model or all.

    ``high_marks(partition, high_mark)`` has one row per topic partition. The model is
    tested on the decoded value, as the key is only a routing hint.
    """
    bounded = rows.filter(F.col("timestamp") >= since)
    if high_marks is not None:
        bounded = bounded.join(high_marks, "partition").filter(F.col("offset") < F.col("high_mark"))
    decoded = bounded.select("partition", "offset", F.from_json("value", schema).alias("r")).select(
        "partition", "offset", "r.*"
    )
    return decoded if model is None else decoded.filter(F.col("model") == model)


def publish(records: DataFrame, bootstrap: str, topic: str = DEFAULT_TOPIC) -> None:
    """Write records to a topic. Needs the Kafka connector on the class path."""
    rows = to_topic_rows(records, topic)
    rows.write.format("kafka").option("kafka.bootstrap.servers", bootstrap).save()


def to_topic_rows(records: DataFrame, topic: str = DEFAULT_TOPIC) -> DataFrame:
    """Key by model, value is the whole record as JSON."""
    return records.select(
        F.lit(topic).alias("topic"), F.col("model").alias("key"),
        F.to_json(F.struct(*records.columns)).alias("value"),
    )
