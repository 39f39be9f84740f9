"""Answers of models and rules, and the records they leave behind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelkeel.functions.ids import request_id
from modelkeel.functions.text import contains_any
from modelkeel.functions.vectors import positive_proba
from modelkeel.operators.histograms import exact_quantiles
from modelkeel.session import broadcast_if_small

#: Rules of the fallback fraud check and the class order of the categorizer.
PRICE_FLOOR = 1.0
BELOW_MEDIAN = 0.15
MEDIANS = {"electronics": 350.0, "fashion": 40.0, "home": 90.0, "sports": 120.0, "books": 12.0, "kids": 45.0}
KEYWORDS = ("urgent", "whatsapp", "western union", "paypal friends", "shipping only", "deposit first")
SCORE_SUSPICIOUS, SCORE_CLEAN = 0.9, 0.05
SUSPICIOUS_FROM = 0.5
CATEGORIES = ("books", "electronics", "fashion", "home", "kids", "sports")
RULES_VERSION = "rules"


def medians_table(spark, medians: Mapping[str, float] = MEDIANS) -> DataFrame:
    return spark.createDataFrame(list(medians.items()), "category string, median double")


def category_medians(reference: DataFrame, category: str = "category", price: str = "price") -> DataFrame:
    """Medians of the frozen reference per category, exact for a category of any size."""
    return exact_quantiles(reference, price, [category], [0.5]).select(
        F.col(category).alias("category"), F.col("value").alias("median")
    )


def fraud_reasons(price: Column, median: Column, title: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """Names of the rules that fire, in rule order. A category without a median has no floor rule."""
    return F.array_compact(
        F.array(
            F.when(price <= PRICE_FLOOR, F.lit("price_at_floor")),
            F.when((median != 0) & (price < BELOW_MEDIAN * median), F.lit("price_below_category_floor")),
            F.when(contains_any(title, tuple(keywords)), F.lit("suspicious_keyword")),
        )
    )


def fraud_rules(listings: DataFrame, medians: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Add ``reasons`` and ``score`` from price, category and title.

    ``medians`` has one row per category of the use case; it is broadcast only after counting it.
    """
    known = listings.join(broadcast_if_small(medians), "category", "left")
    scored = known.withColumn("reasons", fraud_reasons(F.col("price"), F.col("median"), F.col("title"), keywords))
    return scored.withColumn(
        "score", F.when(F.size("reasons") > 0, F.lit(SCORE_SUSPICIOUS)).otherwise(F.lit(SCORE_CLEAN))
    ).drop("median")


def score_with_fallback(
    listings: DataFrame, medians: DataFrame, model_version: str, *, proba: str = "proba",
    keywords: Sequence[str] = KEYWORDS,
) -> DataFrame:
    """The model's verdict where it answered, the rules' where it did not (``proba`` null).

    Adds ``score, source, model_version, reasons, is_suspicious``.
    """
    ruled = fraud_rules(listings, medians, keywords)
    answered = F.col(proba).isNotNull()
    raw = F.when(answered, positive_proba(F.col(proba))).otherwise(F.col("score"))
    return (
        ruled.withColumn("_raw", raw)
        .withColumn("is_suspicious", F.col("_raw") >= SUSPICIOUS_FROM)
        .withColumn("score", F.round("_raw", 4))
        .withColumn("source", F.when(answered, F.lit("model")).otherwise(F.lit("fallback")))
        .withColumn("model_version", F.when(answered, F.lit(model_version)).otherwise(F.lit(RULES_VERSION)))
        .withColumn("reasons", F.when(answered, F.array().cast("array<string>")).otherwise(F.col("reasons")))
        .drop("_raw")
    )


def prediction_records(
    answers: DataFrame, features: Sequence[str], *, model: Column, version: Column, prediction: Column,
    ts: Column, key: Sequence[str], score: Column | None = None, source: Column | None = None,
    given_id: Column | None = None,
) -> DataFrame:
    """Records of answers: envelope plus the features spread next to it."""
    columns = [
        ts.alias("ts"),
        request_id(F.lit(None).cast("string") if given_id is None else given_id, *key).alias("request_id"),
        *[F.col(f) for f in features],
        model.alias("model"), version.alias("model_version"), prediction.alias("prediction"),
    ]
    if score is not None:
        columns.append(score.alias("score"))
    columns.append((F.lit("model") if source is None else source).alias("source"))
    return answers.select(*columns)


def model_sourced(records: DataFrame) -> DataFrame:
    """Only records a model answered; rule answers are not drift evidence."""
    return records.filter(F.col("source") == "model")


def instances_payload(features: Sequence[str]) -> Column:
    """Request body of a model server: one instance whose columns are one-element lists."""
    instance = F.struct(*[F.array(F.col(f)).alias(f) for f in features])
    return F.to_json(F.struct(F.array(instance).alias("instances")))
