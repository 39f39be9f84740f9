"""Champion/challenger gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeel.operators.metrics import class_f1, confusion
from modelkeel.spec import ModelSpec

NO_CHAMPION = "no champion yet"


def gate_columns(
    metric: Column, candidate: Column, champion: Column, higher_is_better: Column, min_improvement: Column
) -> tuple[Column, Column]:
    """``(promote, reason)`` as columns; NaN never promotes although Spark sorts it highest."""
    gain = F.when(higher_is_better, candidate - champion).otherwise(champion - candidate)
    better = champion.isNull() | (~F.isnan(gain) & (gain > min_improvement))
    reason = (
        F.when(champion.isNull(), F.lit(NO_CHAMPION))
        .when(better, F.format_string("%s improved by %.4f", metric, gain))
        .otherwise(F.format_string("%s did not improve (%+.4f, need > %s)", metric, gain, min_improvement.cast("string")))
    )
    return F.coalesce(better, F.lit(False)), reason


def decide(spark: SparkSession, spec: ModelSpec, candidate: float, champion: float | None) -> tuple[bool, str]:
    """The decision of :func:`gate_columns` for one model and two measured values."""
    columns = gate_columns(
        F.lit(spec.primary_metric), F.lit(float(candidate)), F.lit(champion).cast("double"), F.lit(spec.higher_is_better),
        F.lit(spec.min_improvement),
    )
    return tuple(spark.range(1).select(*columns).first())


def compare_f1_macro(holdout: DataFrame, y: str, candidate: str, champion: str) -> DataFrame:
    """Macro F1 of both models on the same rows, from one scan: ``candidate, champion``.

    Each row is counted once per model before the only shuffle.
    """
    sides = F.array(
        F.struct(F.lit("candidate").alias("role"), F.col(candidate).alias("p")),
        F.struct(F.lit("champion").alias("role"), F.col(champion).alias("p")),
    )
    long = holdout.select(F.col(y).alias("truth"), F.inline(sides))
    per_model = class_f1(confusion(long, "truth", "p", ["role"]), ["role"]).groupBy("role").agg(F.avg("f1").alias("f1"))
    return per_model.agg(
        F.max(F.when(F.col("role") == "candidate", F.col("f1"))).alias("candidate"),
        F.max(F.when(F.col("role") == "champion", F.col("f1"))).alias("champion"),
    )
