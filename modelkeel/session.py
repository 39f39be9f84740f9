"""Session defaults, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Runtime settings every job of the library relies on.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: State store used by the keyed state machines; large state stays off the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs assume and return the session."""
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: there driver and
    executors are one machine. On a cluster an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_fallback()


@cache
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="modelkeel-")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back (cuts lineage)."""
    path = fresh_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles that no table refers to any more; it does so when the driver collects its garbage.

    For use between steps that move a table each, after a step was landed.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` landed and that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Plans made within hand at most so many rows at once to Python; for rows of several kilobytes, as vectors of texts are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few driver rows as a local relation, which needs no job to be scanned or broadcast."""
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work all cores when the input has fewer splits than cores.

    A table of any size has more splits than that and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a side only when it really has at most ``max_rows`` rows.

    The side is computed once, up to ``max_rows + 1`` rows. If it ends before that, the rows
    themselves become the broadcast, so nothing is computed again. A larger side is returned
    as it is: Spark joins it with a shuffle and AQE splits the skewed partitions.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))
