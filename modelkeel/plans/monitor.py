"""The drift monitor: champion's reference against its own recent traffic, per model."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeel.operators import drift
from modelkeel.operators.registry import IN_FLIGHT
from modelkeel.plans.pipeline import Run, champion
from modelkeel.schema import columns
from modelkeel.sources.datasets import read_dataset
from modelkeel.sources.metric_text import as_metric_rows, drift_gauges

RETRAIN_REQUESTS = columns(use_case="string", model="string", ts="timestamp", max_psi="double", trigger="string")


def check_model(
    run: Run, records: DataFrame, now: datetime, *, window_minutes: int = drift.WINDOW_MINUTES, warn: float = drift.WARN,
    retrain: float = drift.RETRAIN, min_rows: int = drift.MIN_ROWS, in_flight: DataFrame | None = None, dry_run: bool = False,
) -> dict:
    """Judge one model. ``records`` is the log or decoded topic window of any models.

    Cheap tests come first: no champion, no reference, or too few rows end the check before
    anything is binned. ``in_flight`` has ``use_case, model, phase`` of the pipeline runs.
    """
    spec, known = run.spec, champion(run)
    if known is None:
        return run.done("drift", skipped="no champion yet")
    uri = known["tags"].get("reference_uri", "")
    if not uri:
        return run.done("drift", skipped="champion has no reference")
    reference = read_dataset(run.spark, uri)
    bound = F.lit(now).cast(records.schema["ts"].dataType)
    live = drift.recent(_own_records(run, records, now, window_minutes), bound, window_minutes)
    if "model_version" in live.columns:
        live = live.filter(F.col("model_version").cast("string") == str(known["version"]))
    live = live.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _judge(run, reference, live, known, now, window_minutes, warn, retrain, min_rows, in_flight, dry_run)
    finally:
        live.unpersist()


def _own_records(run: Run, records: DataFrame, now: datetime, minutes: int) -> DataFrame:
    """Records of the run's model and use case; with the log's partition columns, only of the days of the window."""
    own = records.filter(F.col("model") == run.model)
    if "use_case" in records.columns:
        own = own.filter(F.col("use_case") == run.use_case.name)
    if "date" in records.columns:
        own = own.filter(F.col("date") >= f"{now - timedelta(minutes=minutes):%Y-%m-%d}")
    return own


def _judge(run, reference, live, known, now, window_minutes, warn, retrain, min_rows, in_flight, dry_run) -> dict:
    spec = run.spec
    rows = live.count()
    watched = drift.shared_columns(tuple(spec.drift_columns), reference, live)
    if rows < min_rows or not watched:
        if not dry_run:
            _publish_idle(run, now, rows, warn, retrain)
        return run.done("drift", skipped=f"{rows} rows < {min_rows} or no comparable columns", rows=rows)
    reference, compared = drift.as_prediction(reference, live, spec.target, watched)
    report = drift.psi_by_column(reference, live, compared).withColumns(
        {"use_case": F.lit(run.use_case.name), "model": F.lit(run.model)}
    )
    psi = {r["column"]: r["psi"] for r in report.collect()}  # one row per declared column
    worst = max(psi.values(), default=0.0)
    level = "retrain" if worst > retrain else "warn" if worst > warn else "ok"
    requested = False
    if not dry_run:
        scored = run.spark.createDataFrame(
            [(run.use_case.name, run.model, c, v, rows) for c, v in psi.items()],
            columns(use_case="string", model="string", column="string", psi="double", n_live="long"),
        )
        gauges = drift_gauges(scored, warn=warn, retrain=retrain, now=F.lit(now))
        _append_metrics(run, as_metric_rows(gauges, F.lit(now).cast("timestamp")))
        requested = level == "retrain" and not _busy(run, in_flight)
        if requested:
            run.append("retrain_requests", [(run.use_case.name, run.model, now, worst, "drift")], RETRAIN_REQUESTS)
    return run.done(
        "drift", level=level, max_psi=round(worst, 4), psi=psi, rows=rows, window_minutes=window_minutes,
        champion_version=known["version"], retrain_requested=requested,
    )


def _busy(run: Run, in_flight: DataFrame | None) -> bool:
    if in_flight is None:
        return False
    mine = in_flight.filter((F.col("use_case") == run.use_case.name) & (F.col("model") == run.model))
    return not mine.filter(F.coalesce("phase", F.lit("")).isin(*IN_FLIGHT)).isEmpty()


def _append_metrics(run: Run, rows: DataFrame) -> None:
    rows.coalesce(1).write.mode("append").parquet(run.layout.table("metrics"))


def _publish_idle(run: Run, now: datetime, rows: int, warn: float, retrain: float) -> None:
    """A skipped check still reports its row count and thresholds, and that it ran."""
    empty = run.spark.createDataFrame(
        [(run.use_case.name, run.model, "", 0.0, rows)],
        columns(use_case="string", model="string", column="string", psi="double", n_live="long"),
    )
    gauges = drift_gauges(empty, warn=warn, retrain=retrain, now=F.lit(now)).filter(F.coalesce("column", F.lit("-")) != "")
    _append_metrics(run, as_metric_rows(gauges, F.lit(now).cast("timestamp")))


def check_all(runs: list[Run], records: DataFrame, now: datetime, **options) -> dict[str, dict]:
    """Every model of a use case against one prediction log."""
    return {r.model: check_model(r, records, now, **options) for r in runs}
