"""Two ready use cases over frames the caller provides: listings and deliveries.

A model is a :class:`Recipe`: its declaration, the pipeline that learns it, how its answers look beside the truth, and
what is measured on them. :class:`Declared` builds, feeds and measures any recipe.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeel.functions.text import text_length
from modelkeel.operators import metrics
from modelkeel.operators.rows import ZONES
from modelkeel.operators.scoring import CATEGORIES
from modelkeel.operators.split import cap_rows
from modelkeel.plans.training import (
    binary_text_pipeline, gbt_pipeline, multiclass_text_pipeline, with_class_weights,
)
from modelkeel.spec import ColumnCheck, ModelSpec

#: ``(spark, profile, seed) -> frame``; the source of a use case's raw rows.
Source = Callable[[SparkSession, str | None, int], DataFrame]


class BalancedText(Pipeline):
    """A text classifier that balances its classes before fitting."""

    def __init__(self, inner: Pipeline, target: str):
        super().__init__(stages=inner.getStages())
        self.target = target

    def fit(self, dataset: DataFrame, params=None) -> PipelineModel:
        return super().fit(with_class_weights(dataset, self.target), params)


@dataclass(frozen=True)
class Recipe:
    """``learn(rows)`` gives the estimator; ``answers`` are columns of the scored frame that ``measure`` reads."""

    spec: ModelSpec
    learn: Callable[[int], Estimator]
    answers: Mapping[str, Column]
    measure: Callable[[DataFrame], dict[str, float]]


def _by_task(answered: DataFrame) -> dict[str, float]:
    return {r["metric"]: r["value"] for r in metrics.metrics_for_task(answered, "classification", "y", "pred").collect()}


def _binary(answered: DataFrame) -> dict[str, float]:
    area = metrics.roc_auc(answered, F.col("y"), F.col("score")).first()[0]
    return metrics.evaluate(answered, metrics.binary_prf(F.col("y"), F.col("pred"))) | {"roc_auc": area}


def _errors(answered: DataFrame) -> dict[str, float]:
    return metrics.evaluate(answered, metrics.regression(F.col("y"), F.col("pred")))


class Declared:
    """A use case given by declarations: recipes by model name, column checks, and derived columns."""

    name: str
    checks: Mapping[str, ColumnCheck]
    derived: Mapping[str, Column] = {}

    def __init__(self, source: Source, key: tuple[str, ...] = ()):
        self.source, self.key = source, key
        self.recipes = {r.spec.name: r for r in self.declare()}
        self.models = {name: r.spec for name, r in self.recipes.items()}

    def declare(self) -> tuple[Recipe, ...]:
        raise NotImplementedError

    def ingest(self, spark: SparkSession, model: str, *, profile: str | None = None, seed: int = 42, rows: int | None = None) -> DataFrame:
        frame = self.source(spark, profile, seed)
        return cap_rows(frame, self.key or frame.columns, rows, seed=seed).withColumns(dict(self.derived))

    def schema(self, model: str) -> Mapping[str, ColumnCheck]:
        return self.checks

    def build_model(self, model: str, rows: int) -> Estimator:
        return self.recipes[model].learn(rows)

    def evaluate(self, model: str, fitted: PipelineModel, df: DataFrame) -> dict[str, float]:
        recipe = self.recipes[model]
        return recipe.measure(fitted.transform(df).select(*[c.alias(n) for n, c in recipe.answers.items()]))


#: Names, inputs, metrics, watched columns and bounds of the two use cases.
LISTING_FEATURES, LISTING_DRIFT = ("title", "price"), ("price", "title_len")
LISTING_CHECKS = {
    "title": ColumnCheck("string"),
    "price": ColumnCheck("number", min=0.01, max=100_000),
    "title_len": ColumnCheck("int", min=1),
    "category": ColumnCheck("string", allowed=CATEGORIES),
    "is_fraud": ColumnCheck("bool"),
}
DELIVERY_FEATURES, DELIVERY_DRIFT = ("distance_km", "weight_kg", "hour", "zone"), ("distance_km", "hour", "weight_kg")
DELIVERY_CHECKS = {
    "distance_km": ColumnCheck("number", min=0.1, max=100),
    "weight_kg": ColumnCheck("number", min=0.01, max=50),
    "hour": ColumnCheck("int", min=0, max=23),
    "zone": ColumnCheck("string", allowed=ZONES),
    "eta_minutes": ColumnCheck("number", min=1),
}


class Listings(Declared):
    """Category and fraud of a listing from its title and price."""

    name = "listings"
    checks = LISTING_CHECKS

    @property
    def derived(self) -> Mapping[str, Column]:
        return {"title_len": text_length("title")}

    def declare(self) -> tuple[Recipe, ...]:
        category = Recipe(
            ModelSpec("categorizer", "category", LISTING_FEATURES, "f1_macro", drift_columns=LISTING_DRIFT),
            lambda rows: multiclass_text_pipeline("title", ["price"], "category", rows),
            {"y": F.col("label"), "pred": F.col("prediction")}, _by_task,
        )
        fraud = Recipe(
            ModelSpec("fraud", "is_fraud", LISTING_FEATURES, "f1", drift_columns=LISTING_DRIFT),
            lambda rows: BalancedText(binary_text_pipeline("title", ["price"], rows), "is_fraud"),
            {"y": F.col("is_fraud").cast("boolean"), "pred": F.col("prediction") == 1.0, "score": vector_to_array("probability")[1]},
            _binary,
        )
        return category, fraud


class Deliveries(Declared):
    """Minutes from order to door."""

    name = "deliveries"
    checks = DELIVERY_CHECKS

    def declare(self) -> tuple[Recipe, ...]:
        return (Recipe(
            ModelSpec("eta", "eta_minutes", DELIVERY_FEATURES, "mae", higher_is_better=False, drift_columns=DELIVERY_DRIFT),
            lambda rows: gbt_pipeline(["distance_km", "weight_kg", "hour"], ["zone"], "eta_minutes"),
            {"y": F.col("eta_minutes"), "pred": F.col("prediction")}, _errors,
        ),)
