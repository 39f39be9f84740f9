"""JSON lines with fields nobody declared: every key of any line becomes a column.

The lines are parsed once into ``VARIANT`` values and landed. One aggregation over them merges the schemas of all
lines, task by task; what comes to the driver is the merged schema, as wide as there are different keys, whatever
the number of lines. The columns are then cut out of the landed values by the merged types.

A key whose values have one type gets that type; whole numbers and fractions together are doubles. A key whose values
have several types stays a ``VARIANT``, so no value is changed by another line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeel.session import materialise

#: Column of the lines that are no JSON object.
CORRUPT = "_corrupt_record"


def parsed_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``v, _corrupt_record`` of every line that is not blank; a line that is no object keeps its text beside a null."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = lines.select("value", F.try_parse_json("value").alias("v"))
    object_ = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT<"))
    is_object = F.coalesce(object_, F.lit(False))
    return parsed.select(F.when(is_object, F.col("v")).alias("v"), F.when(~is_object, F.col("value")).alias(CORRUPT))


def _as_struct(merged: str) -> str:
    """The merged schema as a struct type; names in backticks are left as they are."""
    return re.sub(r"(`(?:[^`]|``)*`)|\bOBJECT<", lambda m: m[1] or "STRUCT<", merged)


def _settled(kind: T.DataType) -> T.DataType:
    """Types that hold what JSON says: fractions are doubles, a key that is always null is text."""
    if isinstance(kind, T.DecimalType):
        return kind if kind.scale == 0 else T.DoubleType()
    if isinstance(kind, T.FloatType):
        return T.DoubleType()
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_settled(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in kind.fields])
    return kind


def merged_schema(parsed: DataFrame) -> T.StructType:
    """All keys of all objects, in the order of their names, with merged types. No object gives no field."""
    merged = parsed.where("v IS NOT NULL").agg(F.schema_of_variant_agg("v").alias("s")).first()["s"]
    if merged is None or not merged.startswith("OBJECT<") or merged == "OBJECT<>":
        return T.StructType([])
    struct = T.StructType.fromDDL(f"`c` {_as_struct(merged)}").fields[0].dataType
    return _settled(struct)


def _path(name: str) -> str:
    """A key as a path; only one with both kinds of quotes cannot be spelled."""
    if '"' not in name:
        return f'$["{name}"]'
    if "'" in name:
        raise ValueError(f"a key with both kinds of quotes has no path: {name}")
    return f"$['{name}']"


def _spelled(kind: T.DataType) -> str:
    """A type as text, with the names of fields in backticks."""
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_spelled(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        fields = (f"`{f.name.replace('`', '``')}`: {_spelled(f.dataType)}" for f in kind.fields)
        return f"STRUCT<{', '.join(fields)}>"
    return kind.simpleString()


def columns_of(value: str, schema: T.StructType) -> list[Column]:
    """The keys as columns; a JSON null is a null, also among values of several types."""
    def cut(f: T.StructField) -> Column:
        column = F.variant_get(value, _path(f.name), _spelled(f.dataType))
        return F.when(~F.is_variant_null(column), column) if isinstance(f.dataType, T.VariantType) else column

    return [cut(f).alias(f.name) for f in schema.fields]


def read_json_union(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of JSON lines with a column for every key of any line; what a line lacks is null.

    Blank lines vanish. Lines that are no object are kept as rows of nulls with their text in ``_corrupt_record``, which is
    there only if such a line is. Equal keys that differ in case are columns of their own.
    """
    landed = materialise(parsed_lines(spark, paths), "json-lines")
    schema = merged_schema(landed)
    known = columns_of("v", schema)
    bad = landed.where(F.col(CORRUPT).isNotNull())
    return landed.select(*known) if bad.isEmpty() else landed.select(*known, CORRUPT)


def variant_text(column: Column | str) -> Column:
    """A ``VARIANT`` as its JSON text, or the bare text if it is a string."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.try_variant_get(column, "$", "string"), F.to_json(column))
