"""The monitor's memory: counts of live rows by pane, absorbed file by file, and the bins they were counted in.

A reference's bins are frozen once and kept. After that every run of the monitor lists the log, counts the files it has not
seen, and appends their counts by pane, model, version, column and bin; rows are read once, however often and for however
many windows a model is judged. All models are judged by one grouped report over the panes of a window.

A run writes its counts into a folder with its number and only then the list of files it has read. A run that fails before
the list is repeated under the same number and overwrites what it had written, so no file counts twice or is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeel.operators import drift
from modelkeel.schema import columns
from modelkeel.session import broadcast_if_small

FILES = columns(file="string", modified="timestamp", run="long")


class PaneStore:
    """Pane counts below ``root`` for the watched columns; ``by`` are the keys of a reference, ``extra`` those of live rows alone."""

    def __init__(self, spark: SparkSession, root: str, watched: Sequence[str], by: Sequence[str], extra: Sequence[str] = ("model_version",),
                 pane: str = "1 hour"):
        self.spark, self.root, self.watched, self.by, self.extra, self.pane = spark, root.rstrip("/"), list(watched), list(by), list(extra), pane

    def freeze(self, reference: DataFrame) -> None:
        """Keep the bins and counts of the reference; a store has one."""
        edges, shares = drift.reference_bins(reference, self.watched, self.by)
        edges.write.mode("errorifexists").parquet(f"{self.root}/edges")
        shares.write.mode("errorifexists").parquet(f"{self.root}/shares")

    def _edges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/edges")

    def files(self) -> DataFrame:
        """``file, modified, run`` of everything absorbed so far."""
        return self._written("files", FILES)

    def _written(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def absorb(self, log: str, schema: T.StructType, source: str = "parquet") -> int:
        """Count the files of ``log`` that are new; returns their number. Files that were read are never opened again.

        The new files' names pass through the driver, which plans the scan of just these.
        """
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(log)
        known = self.files()
        found = listed.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"))
        new = found.join(known.select("file"), "file", "left_anti").collect()
        if not new:
            return 0
        run = known.agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0] + 1
        live = self.spark.read.schema(schema).format(source).option("basePath", log).load([r["file"] for r in new])
        numeric = drift.numeric_columns(live, self.watched)
        counted = drift.live_panes(live, self._edges(), self.watched, self.by, numeric, self.pane, self.extra)
        by_day = counted.withColumn("day", F.date_format("pane", "yyyy-MM-dd"))
        by_day.write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/panes/run={run}")
        listing = self.spark.createDataFrame([(r["file"], r["modified"]) for r in new], T.StructType(FILES.fields[:2]))
        listing.write.mode("errorifexists").parquet(f"{self.root}/files/run={run}")
        return len(new)

    def panes(self, start: datetime, end: datetime) -> DataFrame:
        """Counts ``pane, by…, extra…, column, bin, n`` of the panes from ``start`` to before ``end``; days outside are not read.

        Only runs whose list of files is there count.
        """
        runs = broadcast_if_small(self.files().select("run").distinct())
        counts = self.spark.read.option("basePath", f"{self.root}/panes").parquet(f"{self.root}/panes")
        day = F.col("day").cast("string")
        inside = counts.where((day >= f"{start:%Y-%m-%d}") & (day <= f"{end:%Y-%m-%d}")).join(runs, "run", "left_semi")
        kind = inside.schema["pane"].dataType
        inside = inside.where((F.col("pane") >= F.lit(start).cast(kind)) & (F.col("pane") < F.lit(end).cast(kind)))
        return inside.groupBy("pane", *self.by, *self.extra, "column", "bin").agg(F.sum("n").alias("n"))

    def report(self, start: datetime, end: datetime, *, champions: DataFrame | None = None, min_rows: int = drift.MIN_ROWS) -> DataFrame:
        """``by…, extra…, column, n_live, psi, skipped`` of all models in one job, over the panes of a window.

        With ``champions`` (by…, version) only rows that the champion answered count; versions compare as text.
        """
        keys = [*self.by, *self.extra]
        live = self.panes(start, end).groupBy(*keys, "column", "bin").agg(F.sum("n").alias("c_live"))
        if champions is not None:
            live = drift.champion_rows(live, champions, self.by)
        shares = self.spark.read.parquet(f"{self.root}/shares")
        return drift.psi_of_counts(live, self._edges(), shares, keys, self.by, min_rows=min_rows)

    def levels(self, report: DataFrame, warn: float = drift.WARN, retrain: float = drift.RETRAIN) -> DataFrame:
        """``by…, extra…, max_psi, n_live, level``: one row a model, ``skipped`` where it had too few rows."""
        judged = drift.drift_levels(report, [*self.by, *self.extra], warn, retrain)
        return judged.withColumn("level", F.when(F.col("max_psi").isNull(), F.lit("skipped")).otherwise(F.col("level")))
