"""Rates, ratios, latest values and staleness over call logs and metric samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelkeel.operators.ordered import lag_chunked

#: Service-level limits and the staleness limit of the monitor (seconds).
FALLBACK_WARN, FALLBACK_CRITICAL = 0.05, 0.2
ERROR_LIMIT = 0.05
P99_LIMIT = 0.3
STALE_SECONDS = 1800


def window_start(ts: str, length: str) -> Column:
    return F.window(ts, length).getField("start")


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def ratio_by_window(calls: DataFrame, hit: Column, by: Sequence[str], length: str, name: str = "ratio") -> DataFrame:
    """Share of calls with ``hit`` per window and key, in one pass.

    Numerator and denominator come from the same rows, so no second series has to be joined;
    a key without calls in a window has no row.
    """
    return calls.groupBy(window_start("ts", length).alias("window_start"), *by).agg(
        F.count(F.lit(1)).alias("calls"), _share(hit).alias(name)
    )


def graded(ratios: DataFrame, name: str, warn: float, critical: float) -> DataFrame:
    """Strict thresholds: on the limit is still fine."""
    grade = F.when(F.col(name) > critical, F.lit("critical")).when(F.col(name) > warn, F.lit("warning"))
    return ratios.withColumn("severity", F.coalesce(grade, F.lit("ok")))


def rate_by_window(df: DataFrame, by: Sequence[str], length: str, seconds: int) -> DataFrame:
    """Events per second and key in each window."""
    return df.groupBy(window_start("ts", length).alias("window_start"), *by).agg(
        (F.count(F.lit(1)) / F.lit(float(seconds))).alias("rate")
    )


def count_by_window(df: DataFrame, by: Sequence[str], length: str, having: Column | None = None) -> DataFrame:
    counted = df.groupBy(window_start("ts", length).alias("window_start"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted if having is None else counted.filter(having)


def latest(df: DataFrame, by: Sequence[str | Column], value: str, order: Sequence[str]) -> DataFrame:
    """Last value per key as an aggregation: one partial row per key and task."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_gauges(samples: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Last value per metric name and label set; the set is compared as sorted entries."""
    keyed = samples.withColumn("label_set", F.array_sort(F.map_entries("labels")))
    return keyed.groupBy("name", "label_set").agg(F.max_by("value", F.struct(*order)).alias("value")).select(
        "name", F.map_from_entries("label_set").alias("labels"), "value"
    )


def label_values(samples: DataFrame, name: str, label: str) -> DataFrame:
    return samples.filter(F.col("name") == name).select(F.col("labels").getItem(label).alias(label)).distinct()


def staleness(samples: DataFrame, by: Sequence[str], now: Column, limit: int = STALE_SECONDS) -> DataFrame:
    """Seconds since the last sample per key, and whether that is more than ``limit``."""
    last = samples.groupBy(*by).agg(F.max("ts").alias("last_ts"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_ts")
    return last.select(*by, age.alias("age_seconds"), (age > limit).alias("stale"))


def outcome_mix(calls: DataFrame, by: str, outcome: str, known: Sequence[str]) -> DataFrame:
    """Calls per outcome as columns; ``known`` fixes them, so no pass is needed to find them."""
    return calls.groupBy(by).pivot(outcome, list(known)).agg(F.count(F.lit(1))).na.fill(0)


def fallback_reasons(calls: DataFrame, by: Sequence[str], reason: str, fallback: Column) -> DataFrame:
    """``by…, reason, n, share``: why answers came from a fallback, and the part of all calls that each reason makes.

    All calls are counted in the same pass; keys without a fallback have no row.
    """
    counted = calls.groupBy(*by, F.when(fallback, F.coalesce(F.col(reason), F.lit("unknown"))).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by)  # one row a reason
    return counted.withColumn("share", F.col("n") / F.sum("n").over(whole)).filter(F.col("reason").isNotNull())


def counter_increase(
    samples: DataFrame, series: Sequence[str], length: str, *, order: Sequence[str] = ("ts", "id"), value: str = "value",
    **chunking,
) -> DataFrame:
    """Reset-corrected increase per series and window; a delta belongs to its later sample.

    A value below its predecessor means the counter restarted from zero.
    """
    with_previous = lag_chunked(samples, series, order, value, "previous", **chunking)
    current, previous = F.col(value), F.col("previous")
    delta = F.when(previous.isNull(), 0).when(current < previous, current).otherwise(current - previous)
    return with_previous.groupBy(window_start("ts", length).alias("window_start"), *series).agg(
        F.sum(delta).alias("increase")
    )
