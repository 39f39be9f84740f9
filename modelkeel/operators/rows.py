"""Row-level request validation: valid rows and a quarantine with reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of a listing request and of a delivery request.
TITLE_MAX = 300
PRICE_MAX = 1_000_000.0
DELIVERY_RANGES = {"distance_km": (0.0, 100.0), "weight_kg": (0.0, 50.0), "hour": (0, 23)}
ZONES = ("north", "south", "east", "west")


def with_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``reasons`` (names of the rules a row breaks) and ``valid``; null breaks a rule."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    flagged = df.withColumn("reasons", F.array_compact(F.array(*broken)))
    return flagged.withColumn("valid", F.size("reasons") == 0)


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantine)``; the quarantine keeps its reasons."""
    flagged = with_reasons(df, rules)
    return flagged.filter("valid").drop("reasons", "valid"), flagged.filter("NOT valid").drop("valid")


def listing_rules() -> dict[str, Column]:
    return {
        "title": F.length("title").between(1, TITLE_MAX),
        "price": (F.col("price") > 0) & (F.col("price") <= PRICE_MAX),
    }


def delivery_rules() -> dict[str, Column]:
    """Distance and weight are open below zero, the hour range is closed, the zone is an enum."""
    rules = {}
    for name, (low, high) in DELIVERY_RANGES.items():
        above = F.col(name) >= low if name == "hour" else F.col(name) > low
        rules[name] = above & (F.col(name) <= high)
    rules["zone"] = F.col("zone").isin(*ZONES)
    return rules
