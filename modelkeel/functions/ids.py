"""Reproducible ids and hashes (md5, so that any SQL engine can repeat them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_hash(seed: int | str, *keys: Column | str) -> Column:
    """Pseudo-random order key of a row: md5 of the seed and the row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(k) for k in keys]).cast("binary"))


def _text(key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def request_id(given: Column, *key: Column | str) -> Column:
    """The caller's id, or 12 hex characters derived from the row."""
    derived = F.substring(F.md5(F.concat_ws("|", *[_text(k) for k in key]).cast("binary")), 1, 12)
    return F.coalesce(F.nullif(given, F.lit("")), derived)


def exact_double(x: Column) -> Column:
    """Every finite double as a hexadecimal fraction and a power of two, which only that double has. Both zeros are 0."""
    special = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(x == 0, "0")
    return special.otherwise(F.format_string("%a", x))


def canonical_text(field: T.StructField) -> Column:
    """One spelling per value, after its length; null has a spelling that no value has."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        text = exact_double(column.cast("double"))
    elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(field.dataType, T.AtomicType):
        text = column.cast("string")
    else:
        text = F.to_json(F.struct(column))
    return F.when(column.isNull(), F.lit("~")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def row_hash(df: DataFrame) -> Column:
    return F.md5(F.concat(F.lit(""), *[canonical_text(f) for f in df.schema.fields]).cast("binary"))


def schema_text(schema: T.StructType) -> str:
    """Names and types of the columns, as they enter the content hash."""
    return ",".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def hash_word(digest: Column, index: int) -> Column:
    """The ``index``-th 32-bit word (0…3) of an md5 digest as a number."""
    return F.conv(F.substring(digest, 1 + 8 * index, 8), 16, 10).cast("decimal(20,0)")


def data_hash(df: DataFrame) -> DataFrame:
    """Content hash of a frame in one aggregation: 16 hex characters, row order irrelevant.

    Column names and types are part of it. Sums of the digest words are associative, so each task contributes one partial
    row; equal rows count as often as they occur.
    """
    digest = df.select(row_hash(df).alias("d"))
    sums = [F.sum(hash_word(F.col("d"), i)).alias(f"w{i}") for i in range(4)]
    total = digest.agg(F.count(F.lit(1)).alias("rows"), *sums)
    words = [F.coalesce(F.col(f"w{i}").cast("string"), F.lit("0")) for i in range(4)]
    text = F.concat_ws(":", F.col("rows").cast("string"), *words, F.lit(schema_text(df.schema)))
    return total.select("rows", F.substring(F.md5(text.cast("binary")), 1, 16).alias("data_hash"))
