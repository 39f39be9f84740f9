"""Probability arrays, numbers and small maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numeric code of each breaker state.
CIRCUIT_CODES = {"closed": 0, "half-open": 1, "open": 2}


def argmax_label(proba: Column, labels: Sequence[str]) -> Column:
    """Label of the first largest probability; an index without a label is given as text."""
    index = F.array_position(proba, F.array_max(proba)).cast("int")
    named = F.try_element_at(F.array(*[F.lit(x) for x in labels]), index)
    return F.coalesce(named, (index - 1).cast("string"))


def positive_proba(proba: Column) -> Column:
    """Probability of the positive class: second entry, or the only one."""
    return F.when(F.size(proba) > 1, F.try_element_at(proba, F.lit(2))).otherwise(
        F.try_element_at(proba, F.lit(1))
    )


def as_proba(answer: Column) -> Column:
    """A model answer in JSON, list or bare number, as an array of doubles."""
    listed = F.from_json(answer, "array<double>")
    single = answer.try_cast("double")
    return F.when(single.isNotNull(), F.array(single)).otherwise(listed)


def circuit_code(state: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CIRCUIT_CODES.items() for x in kv]), state)


def prefix_keys(metrics: Column, prefix: str) -> Column:
    return F.transform_keys(metrics, lambda k, _: F.concat(F.lit(prefix), k))


def coerce_number(value: Column) -> Column:
    """Number or null; text that is no number and NaN both become null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def missing(value: Column, is_float: bool) -> Column:
    """Null test that counts NaN as null for floating-point columns."""
    return (value.isNull() | F.isnan(value)) if is_float else value.isNull()


def category(value: Column) -> Column:
    """Category text; null is a category of its own."""
    return F.coalesce(value.cast("string"), F.lit("<null>"))
