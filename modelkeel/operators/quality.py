"""Data-quality gate: declared column checks against a frame of any size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeel.functions.vectors import missing
from modelkeel.spec import ColumnCheck

#: How many unexpected values a message names.
REPORTED_VALUES = 5


class QualityGateFailed(ValueError):
    """Raised by the gate; carries the violation messages."""

    def __init__(self, violations: list[str]):
        super().__init__("data quality: " + "; ".join(violations))
        self.violations = violations


def _is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


#: Spark types each declared dtype accepts.
ACCEPTED = {
    "string": T.StringType,
    "number": T.NumericType,
    "int": T.IntegralType,
    "bool": T.BooleanType,
}


def null_test(df: DataFrame, column: str) -> Column:
    return missing(F.col(column), _is_float(df.schema[column].dataType))


def present_value(df: DataFrame, column: str) -> Column:
    """The value, or null where it counts as missing (so that NaN never is a maximum)."""
    return F.when(~null_test(df, column), F.col(column))


def null_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, rows, null_ratio`` per column in one aggregation; 0.0 for an empty frame."""
    names = columns or df.columns
    aggregates = [F.coalesce(F.avg(null_test(df, c).cast("double")), F.lit(0.0)).alias(c) for c in names]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    return wide.unpivot(["_rows"], names, "column", "null_ratio").withColumnRenamed("_rows", "rows")


def range_checks(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """``column, min_value, max_value, below, above`` for numeric columns in one aggregation."""
    numeric = {c: b for c, b in bounds.items() if _is_number(df.schema[c].dataType)}
    entries = []
    for name, (low, high) in numeric.items():
        value = present_value(df, name).cast("double")
        lowest, highest = F.min(value), F.max(value)
        entries.append(
            F.struct(
                F.lit(name).alias("column"), lowest.alias("min_value"), highest.alias("max_value"),
                F.coalesce(lowest < F.lit(low), F.lit(False)).alias("below"),
                F.coalesce(highest > F.lit(high), F.lit(False)).alias("above"),
            )
        )
    return df.agg(F.array(*entries).alias("checks")).select(F.inline("checks"))


def unexpected_values(df: DataFrame, allowed: Mapping[str, tuple[str, ...]], limit: int = REPORTED_VALUES) -> DataFrame:
    """First ``limit`` values outside the allowed set, as text, per column.

    Values are de-duplicated by a partially aggregated ``groupBy`` and ranked under a
    ``row_number`` limit, which Spark applies before the shuffle; no set of values is
    ever collected in one task.
    """
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                 (F.col(c).isNotNull() & ~F.col(c).isin(*ok)).alias("bad"))
        for c, ok in allowed.items()
    ]
    distinct = (
        df.select(F.explode(F.array(*pairs)).alias("p")).filter("p.bad")
        .groupBy(F.col("p.column").alias("column"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    )
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return distinct.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def missing_columns(df: DataFrame, schema: Mapping[str, ColumnCheck]) -> list[str]:
    """Required columns the frame does not have, in schema order (metadata only)."""
    return [c for c, check in schema.items() if check.required and c not in df.columns]


def _profile(df: DataFrame, schema: Mapping[str, ColumnCheck]) -> dict:
    """All null ratios and extremes the checks need: one job, one row."""
    aggregates = []
    for c, check in schema.items():
        if c not in df.columns:
            continue
        aggregates.append(F.coalesce(F.avg(null_test(df, c).cast("double")), F.lit(0.0)).alias(f"null:{c}"))
        if _is_number(df.schema[c].dataType):
            if check.min is not None:
                aggregates.append(F.min(present_value(df, c)).alias(f"min:{c}"))
            if check.max is not None:
                aggregates.append(F.max(present_value(df, c)).alias(f"max:{c}"))
    return df.agg(*aggregates).first().asDict() if aggregates else {}


def check_frame(df: DataFrame, schema: Mapping[str, ColumnCheck]) -> list[str]:
    """Violation messages in schema order; empty when the frame is fine.

    Two small collects, both bounded by the number of declared columns: one row of
    aggregates, and at most five unexpected values per column with an allowed set.
    """
    profile = _profile(df, schema)
    allowed = {c: check.allowed for c, check in schema.items() if check.allowed is not None and c in df.columns}
    strange: dict[str, list[str]] = {}
    if allowed:
        for row in unexpected_values(df, allowed).collect():
            strange.setdefault(row["column"], []).append(row["value"])
    found = []
    for c, check in schema.items():
        if c not in df.columns:
            found += [f"{c}: missing column"] if check.required else []
            continue
        ratio = profile[f"null:{c}"]
        if ratio > check.max_null_ratio:
            found.append(f"{c}: null ratio {ratio:.3f} > {check.max_null_ratio}")
        kind = df.schema[c].dataType
        if check.dtype in ACCEPTED and not isinstance(kind, ACCEPTED[check.dtype]):
            found.append(f"{c}: expected {check.dtype}, got {kind.simpleString()}")
        lowest, highest = profile.get(f"min:{c}"), profile.get(f"max:{c}")
        if lowest is not None and lowest < check.min:
            found.append(f"{c}: min {lowest} < {check.min}")
        if highest is not None and highest > check.max:
            found.append(f"{c}: max {highest} > {check.max}")
        if strange.get(c):
            found.append(f"{c}: unexpected values {sorted(strange[c])}")
    return found


def violations(df: DataFrame, schema: Mapping[str, ColumnCheck]) -> DataFrame:
    """The messages as rows ``position, violation``."""
    rows = list(enumerate(check_frame(df, schema), start=1))
    return df.sparkSession.createDataFrame(rows, "position int, violation string")


def require(df: DataFrame, schema: Mapping[str, ColumnCheck]) -> None:
    """The gate: raise when anything is wrong."""
    found = check_frame(df, schema)
    if found:
        raise QualityGateFailed(found)


def except_allowed(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Observed values that are not in the one-column frame ``allowed``."""
    return df.select(column).distinct().exceptAll(allowed.select(column).distinct())


def intersect_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).intersect(right.select(column))


def shared_columns(wanted: tuple[str, ...], *frames: DataFrame) -> list[str]:
    """Columns of ``wanted`` every frame has, in the wanted order."""
    return [c for c in wanted if all(c in f.columns for f in frames)]


def union_records(*frames: DataFrame) -> DataFrame:
    """Concatenate records with different keys; absent keys become null."""
    merged, *rest = frames
    for other in rest:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
