"""Alert holds, canary verdicts and failure streaks.

Holds and verdicts work on a regular grid of evaluations (one row per rule, key and step),
which is small next to the calls behind it; streaks work on raw calls and are chunked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelkeel.operators.histograms import INF, LATENCY_BUCKETS, histogram_quantiles
from modelkeel.operators.ordered import streak_chunked
from modelkeel.operators.trailing import panes, trailing

#: Canary analysis limits (error ratio, p99 seconds, fallback ratio), checks
#: per verdict, tolerated failures, seconds between checks and seconds they look back, divisor floor, and the breaker's threshold and cooldown.
CANARY_LIMITS = {"error-ratio": 0.02, "p99-latency": 0.3, "fallback-ratio": 0.2}
CANARY_CHECKS, CANARY_FAILURES = 4, 1
CANARY_STEP, CANARY_RANGE = 30, 120
DIVISOR_FLOOR = 1e-9
BREAKER_FAILURES, BREAKER_COOLDOWN = 5, 30.0


def alert_holds(
    grid: DataFrame, key: Sequence[str], condition: Column, *, step_seconds: int, hold_seconds: int
) -> DataFrame:
    """Spans in which ``condition`` held at every step: ``key…, start_s, end_s, firing, firing_from_s``.

    The grid has evaluation times ``t`` in seconds or window starts. A missing evaluation ends a span like a false one.
    On a grid, consecutive true rows share the value of time minus row number.
    """
    at = F.col("t") if "t" in grid.columns else F.unix_timestamp("window_start")
    true_rows = grid.filter(condition).withColumn("t", at)
    number = F.row_number().over(Window.partitionBy(*key).orderBy("t"))
    spans = true_rows.withColumn("span", F.col("t") - number * step_seconds).groupBy(*key, "span").agg(
        F.min("t").alias("start_s"), F.max("t").alias("end_s")
    )
    firing = F.col("end_s") - F.col("start_s") >= hold_seconds
    return spans.select(
        *key, "start_s", "end_s", firing.alias("firing"),
        F.when(firing, F.col("start_s") + hold_seconds).alias("firing_from_s"),
    )


def safe_ratio(hits: Column, total: Column) -> Column:
    """No hits count as zero, and an empty total is floored, so a quiet series passes."""
    return F.coalesce(hits, F.lit(0)).cast("double") / F.greatest(total.cast("double"), F.lit(DIVISOR_FLOOR))


def canary_checks(
    calls: DataFrame, by: Sequence[str], *, error: Column, fallback: Column, latency: Column, public: Column,
    step: int = CANARY_STEP, reach: int = CANARY_RANGE,
) -> DataFrame:
    """``by…, t, check, value, failed``: the three checks of a canary at every grid time that has calls in its range.

    Two ratios over all calls and the p99 of the public handlers, from one pass that counts calls, hits and buckets by
    pane. Without public calls the p99 counts as zero. Without any call there is no row, which a verdict takes for a pass.
    """
    bounds = [*LATENCY_BUCKETS, INF]
    counted = {"calls": F.count(F.lit(1)), "errors": F.sum(error.cast("long")), "fallbacks": F.sum(fallback.cast("long"))}
    counted |= {f"b{i}": F.sum((public & (latency <= b)).cast("long")) for i, b in enumerate(bounds)}
    seen = trailing(panes(calls, by, step, **counted), by, step, [reach], sums=list(counted)).drop("range")
    buckets = seen.select(*by, "t", F.inline(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])))
    p99 = histogram_quantiles(buckets, [*by, "t"], [0.99]).select(*by, "t", F.col("value").alias("p99"))
    both = seen.select(*by, "t", "calls", "errors", "fallbacks").join(p99, [*by, "t"], "left")
    values = {
        "error-ratio": safe_ratio(F.col("errors"), F.col("calls")),
        "fallback-ratio": safe_ratio(F.col("fallbacks"), F.col("calls")),
        "p99-latency": F.coalesce("p99", F.lit(0.0)),
    }
    cells = F.array(*[
        F.struct(F.lit(c).alias("check"), v.alias("value"), (~(v < CANARY_LIMITS[c])).alias("failed"))
        for c, v in values.items()
    ])
    return both.select(*by, "t", F.inline(cells))


def canary_verdicts(checks: DataFrame, by: Sequence[str], step: int = CANARY_STEP) -> DataFrame:
    """Add ``failures`` among the last four evaluations of a check and ``aborted`` when more than one.

    Evaluations are told apart by their time, so one without a row counts as passed.
    """
    last = Window.partitionBy(*by, "check").orderBy("t").rangeBetween((1 - CANARY_CHECKS) * step, 0)
    counted = checks.withColumn("failures", F.sum(F.col("failed").cast("long")).over(last))
    return counted.withColumn("aborted", F.col("failures") > CANARY_FAILURES)


def failure_streaks(
    calls: DataFrame, key: Sequence[str], failed: Column, *, order: Sequence[str], threshold: int = BREAKER_FAILURES,
    **chunking,
) -> DataFrame:
    """Add ``streak`` (consecutive failures so far) and ``would_open``."""
    with_streak = streak_chunked(calls, key, order, failed, "streak", **chunking)
    return with_streak.withColumn("would_open", F.col("streak") >= threshold)


def streak_lengths(streaks: DataFrame, key: Sequence[str], threshold: int = BREAKER_FAILURES) -> DataFrame:
    """How many streaks reached each length, and whether that length opens the breaker."""
    reached = streaks.filter(F.col("streak") > 0).groupBy(*key, "streak").agg(F.count(F.lit(1)).alias("reached"))
    return reached.withColumn("would_open", F.col("streak") >= threshold)
