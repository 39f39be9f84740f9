"""Quantiles from cumulative histogram buckets, and exact ones from raw values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelkeel.operators.ordered import running_sum_chunked
from modelkeel.session import broadcast_if_small

#: Upper bounds of the latency buckets (seconds); the last bucket is +Inf.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 2.0)
INF = float("inf")


def bucket_counts(df: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """Cumulative ``by…, le, n``: rows with a value up to each bound.

    One pass: all buckets are conditional sums in one aggregation, unpivoted afterwards.
    """
    bounds = [*LATENCY_BUCKETS, INF]
    sums = [F.sum((value <= F.lit(b)).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*sums)
    cells = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])
    return wide.select(*by, F.inline(cells))


def histogram_quantiles(buckets: DataFrame, by: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """``by…, q, value`` by linear interpolation inside the bucket that holds the rank.

    The lowest bucket starts at 0; a rank in the +Inf bucket gives the highest finite bound.
    Buckets may come from many series: equal bounds are added up first. A bound that shows less than
    a lower one, as rates of bounds read apart can, is raised to it. The window sees one row per bound.
    """
    in_order = Window.partitionBy(*by).orderBy("le")
    summed = buckets.groupBy(*by, "le").agg(F.sum("n").alias("n"))
    summed = summed.withColumn("n", F.max("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*by)
    edges = (
        summed.withColumn("below", F.coalesce(F.lag("n").over(in_order), F.lit(0)))
        .withColumn("start", F.coalesce(F.lag("le").over(in_order), F.lit(0.0)))
        .withColumn("total", F.max("n").over(whole))
        .withColumn("top", F.max(F.when(F.col("le") < INF, F.col("le"))).over(whole))
    )
    ranked = edges.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))).withColumn(
        "rank", F.col("q") * F.col("total")
    )
    hit = ranked.filter((F.col("total") > 0) & (F.col("n") >= F.col("rank")) & (
        (F.col("below") < F.col("rank")) | ((F.col("rank") == 0) & (F.col("below") == 0))
    ))
    first = hit.groupBy(*by, "q").agg(F.min_by(F.struct("le", "start", "below", "n", "rank", "top"), "le").alias("b"))
    inside = (F.col("b.rank") - F.col("b.below")) / F.nullif(F.col("b.n") - F.col("b.below"), F.lit(0))
    value = F.when(F.col("b.le") == INF, F.col("b.top")).otherwise(
        F.col("b.start") + (F.col("b.le") - F.col("b.start")) * F.coalesce(inside, F.lit(0.0))
    )
    return first.select(*by, "q", value.alias("value"))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Interpolated quantiles of raw values, exact for keys of any size.

    Equal values are counted together before the shuffle; positions then follow from running
    counts per key in bounded chunks, and at most two values per quantile are interpolated.
    """
    keys = list(by) or ["_all"]
    keyed = df if by else df.withColumn("_all", F.lit(0))
    raw = keyed.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    per_value = raw.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    running = running_sum_chunked(per_value, keys, ["v"], F.col("n"), "upto", measured=raw)
    entries = F.array(*[
        F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("total") - 1)).alias("at")) for q in quantiles
    ])
    wanted = per_value.groupBy(*keys).agg(F.sum("n").alias("total")).select(*keys, entries.alias("w"))
    first = F.col("upto") - F.col("n")  # 0-based position of the first copy

    def holds(position: Column) -> Column:
        return (position >= first) & (position < F.col("upto"))

    hits = running.join(broadcast_if_small(wanted), keys).select(
        *keys, "v", F.explode(F.filter("w", lambda w: holds(F.floor(w["at"])) | holds(F.ceil(w["at"])))).alias("w")
    )
    part = F.max("w.at") - F.floor(F.max("w.at"))
    interpolated = F.min("v") + (F.max("v") - F.min("v")) * part
    return hits.groupBy(*keys, F.col("w.q").alias("q")).agg(interpolated.alias("value")).select(*by, "q", "value")
