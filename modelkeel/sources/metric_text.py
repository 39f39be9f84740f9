"""Metric samples: exposition text to rows, long tables of gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One sample line ``name{labels} value [milliseconds]``; names of the drift gauges.
SAMPLE_LINE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+-?\d+)?\s*$"
LABEL = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'
DRIFT_PSI = "ct_drift_psi"
DRIFT_DETECTED = "ct_drift_detected"
DRIFT_ROWS = "ct_drift_window_rows"
DRIFT_LAST_RUN = "ct_drift_last_run_timestamp_seconds"
DRIFT_WARN = "ct_drift_threshold_warn"
DRIFT_RETRAIN = "ct_drift_threshold_retrain"


def parse_labels(text: Column) -> Column:
    """``k="v",…`` to a map."""
    values = F.transform(F.regexp_extract_all(text, F.lit(LABEL), 2), unescape)
    return F.map_from_arrays(F.regexp_extract_all(text, F.lit(LABEL), 1), values)


def unescape(value: Column) -> Column:
    r"""Label values escape backslash, quote and line feed: ``\\``, ``\"``, ``\n``."""
    hidden = F.replace(value, F.lit("\\\\"), F.lit("\0"))
    plain = F.replace(F.replace(hidden, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\0"), F.lit("\\"))


def parse_samples(lines: DataFrame, column: str = "line") -> DataFrame:
    """Sample lines to ``name, labels, value``; comments and malformed lines are left out.

    Every other column of ``lines`` is kept.
    """
    keep = [c for c in lines.columns if c != column]
    text = F.col(column)
    return lines.filter(text.rlike(SAMPLE_LINE)).select(
        *keep,
        F.regexp_extract(text, SAMPLE_LINE, 1).alias("name"),
        parse_labels(F.regexp_extract(text, SAMPLE_LINE, 2)).alias("labels"),
        F.regexp_extract(text, SAMPLE_LINE, 3).try_cast("double").alias("value"),
    )


def drift_gauges(report: DataFrame, *, warn: float, retrain: float, now: Column) -> DataFrame:
    """Gauge rows of a drift report (``use_case, model, column, psi, n_live``).

    One PSI row per column, and the detected, rows, last-run and threshold gauges once per model.
    """
    per_column = report.select(
        "use_case", "model", F.lit(DRIFT_PSI).alias("name"), F.col("column"), F.col("psi").alias("value")
    )
    per_model = report.groupBy("use_case", "model").agg(
        F.max("psi").alias("worst"), F.max("n_live").alias("rows")
    )
    gauges = {
        DRIFT_DETECTED: (F.col("worst") > retrain).cast("double"),
        DRIFT_ROWS: F.col("rows").cast("double"),
        DRIFT_LAST_RUN: F.unix_timestamp(now).cast("double"),
        DRIFT_WARN: F.lit(float(warn)),
        DRIFT_RETRAIN: F.lit(float(retrain)),
    }
    entries = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in gauges.items()])
    model_rows = per_model.select("use_case", "model", F.explode(entries).alias("g")).select(
        "use_case", "model", F.col("g.name").alias("name"),
        F.lit(None).cast("string").alias("column"), F.col("g.value").alias("value"),
    )
    return per_column.unionByName(model_rows)


def as_metric_rows(gauges: DataFrame, ts: Column) -> DataFrame:
    """Flat gauges to the long table ``ts, name, labels, value``; absent labels are left out."""
    labels = [c for c in gauges.columns if c not in ("name", "value")]
    pairs = [part for c in labels for part in (F.lit(c), F.col(c))]
    return gauges.select(
        ts.alias("ts"), "name",
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("labels"), "value",
    )
