"""Fan-out of one batch to several sinks; a failing sink never stops the others."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from modelkeel.schema import columns

Sink = Callable[[DataFrame, int], None]

OUTCOME = columns(batch_id="long", sink="string", ok="boolean", error="string")


def parquet_sink(path: str) -> Sink:
    """Idempotent sink: a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def json_sink(path: str) -> Sink:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")

    return write


def emit(batch: DataFrame, batch_id: int, sinks: Mapping[str, Sink]) -> DataFrame:
    """Write ``batch`` to every sink and return one outcome row per sink."""
    batch.persist(StorageLevel.MEMORY_AND_DISK)
    outcomes = []
    try:
        for name, write in sinks.items():
            try:
                write(batch, batch_id)
                outcomes.append((batch_id, name, True, ""))
            except Exception as failure:  # a sink's trouble is its own row
                outcomes.append((batch_id, name, False, f"{type(failure).__name__}: {failure}"[:500]))
    finally:
        batch.unpersist()
    return batch.sparkSession.createDataFrame(outcomes, OUTCOME)


def fan_out(sinks: Mapping[str, Sink], outcome_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: emit, then keep the outcome rows of the batch."""

    def process(batch: DataFrame, batch_id: int) -> None:
        emit(batch, batch_id, sinks).coalesce(1).write.mode("overwrite").parquet(
            f"{outcome_path}/batch_id={batch_id}"
        )

    return process
