"""Windowed ratios and drift over streams; late rows within the lateness still count."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelkeel.operators.drift import MIN_ROWS, bin_counts, psi_of_counts


def ratio_stream(calls: DataFrame, hit: Column, by: Sequence[str], length: str) -> DataFrame:
    """``window_start, window_end, by…, calls, ratio`` for each closed window.

    ``calls`` carries a watermark on ``ts``.
    """
    grouped = calls.groupBy(F.window("ts", length).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("calls"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("ratio")
    )
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "calls", "ratio"
    )


def pane_stream(
    live: DataFrame, edges: DataFrame, columns: Sequence[str], by: Sequence[str], numeric: Sequence[str], pane: str,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Bin counts per closed pane. State is one counter per pane, key and bin, not per row.

    Overlapping windows are sums of panes, so rows enter the state once however much the
    windows overlap.
    """
    stamped = live.withColumn("w", F.window("ts", pane))
    return bin_counts(stamped, edges, columns, by, numeric, ("w", *extra))


def window_stream(panes: DataFrame, keys: Sequence[str], window: str, slide: str) -> DataFrame:
    """Slide windows over the pane counts inside the same query."""
    grouped = panes.groupBy(F.window(F.window_time("w"), window, slide).alias("sw"), *keys, "column", "bin").agg(
        F.sum("n").alias("c_live")
    )
    return grouped.select(
        F.col("sw.start").alias("window_start"), F.col("sw.end").alias("window_end"), *keys, "column", "bin", "c_live"
    )


def psi_batches(
    edges: DataFrame, reference_counts: DataFrame, keys: Sequence[str], ref_by: Sequence[str], path: str,
    min_rows: int = MIN_ROWS,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: PSI of the windows that closed in this batch.

    All bins of a window close together, so a batch holds whole windows. A repeated batch
    overwrites its own folder.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        psi = psi_of_counts(
            batch, edges, reference_counts, ["window_start", "window_end", *keys], ref_by, min_rows=min_rows
        )
        psi.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return process
