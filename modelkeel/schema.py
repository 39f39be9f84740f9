"""Schemas without a running session."""

from __future__ import annotations

from pyspark.sql import types as T


def columns(**kinds: str | T.DataType) -> T.StructType:
    """A schema from column names and type names (``string``, ``long``, ``double``, ``timestamp``…)."""
    schema = T.StructType()
    for name, kind in kinds.items():
        schema.add(name, kind)
    return schema
