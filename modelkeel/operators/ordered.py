"""Ordered computations over sequences too long for one task.

A window over ``partitionBy(key).orderBy(ts)`` puts a whole key into one task, which
fails when one key holds a large share of the rows. Here the order axis is cut into
chunks of bounded size first. Each (key, chunk) is computed on its own, one summary row
per (key, chunk) carries the state across chunk borders, and a join on the same
(key, chunk) hands the carried state back. Nothing is approximate: the chunk borders come
from sketched quantiles, but any borders give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows one task should hold, and the most chunks the summaries may have per key.
ROWS_PER_CHUNK = 2_000_000
MAX_CHUNKS = 10_000
#: Distances between chunk numbers: above the number of cuts a tied value can get, and that of the tied values and what
#: lies between them.
TIE_SPAN = 2 * MAX_CHUNKS + 2
VALUE_SPAN = TIE_SPAN * 4 * MAX_CHUNKS


def axis_number(df: DataFrame, column: str) -> Column:
    """An order column as a double that never falls as the column grows (microseconds for times).

    Large whole numbers share a double with their neighbours, so it may only cut the axis, not tell values apart.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(column)).cast("double")
    return F.col(column).cast("double")


def _borders(axis: DataFrame, chunks: int) -> list[float]:
    probabilities = [i / chunks for i in range(1, chunks)]
    return axis.approxQuantile("_axis", probabilities, 1.0 / (2 * chunks))


def _bucket(df: DataFrame, axis: Column, borders: Sequence[float], name: str) -> DataFrame:
    splits = [-float("inf"), *sorted(set(borders)), float("inf")]
    if len(splits) == 2:
        return df.withColumn(name, F.lit(0).cast("int"))
    staged = df.withColumn("_axis", axis)
    bucketizer = Bucketizer(splits=splits, inputCol="_axis", outputCol=name, handleInvalid="keep")
    return bucketizer.transform(staged).drop("_axis").withColumn(name, F.col(name).cast("int"))


def _tied_values(sized: DataFrame, first: str, repeated: Sequence[float], rows_per_chunk: int) -> list:
    """The values, in their own type, that fill a chunk alone; fewer than the chunks, as each holds that many rows."""
    near = sized.filter(axis_number(sized, first).isin(list(repeated)))
    counted = near.groupBy(F.col(first).alias("v")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rows_per_chunk)
    return sorted(r["v"] for r in counted.orderBy(F.desc("n")).limit(MAX_CHUNKS).collect())


def _place_among(value: Column, tied: Sequence, kind: T.DataType) -> Column:
    """0 below the first tied value, 1 on it, 2 between it and the second, and so on: never falls as ``value`` grows."""
    if len(tied) <= 16:
        literals = [F.lit(v).cast(kind) for v in tied]
        return sum((value > v).cast("long") + (value >= v).cast("long") for v in literals)
    known = F.array(*[F.lit(v).cast(kind) for v in tied])
    return (F.size(F.filter(known, lambda v: value > v)) + F.size(F.filter(known, lambda v: value >= v))).cast("long")


def with_chunks(
    df: DataFrame, order: Sequence[str], *, rows_per_chunk: int = ROWS_PER_CHUNK, name: str = "chunk",
    measured: DataFrame | None = None,
) -> DataFrame:
    """Add a ``chunk`` number that never falls as the order columns grow.

    ``order`` is one column, or a time-like column followed by a unique integer tie-breaker.
    A first-column value so frequent that it fills whole chunks gets a place of its own, by
    comparisons in its own type, and is cut further along the tie-breaker, so ties cannot pile
    up in one task either.

    ``measured`` may name a cheaper frame to take sizes and cuts from, such as the raw rows
    ``df`` was aggregated from: they hold the same order columns at least as often.
    """
    first, tie = order[0], order[1] if len(order) > 1 else None
    sized = df if measured is None else measured
    rows = sized.count()
    chunks = min(MAX_CHUNKS, -(-rows // rows_per_chunk))
    if chunks <= 1:
        return df.withColumn(name, F.lit(0).cast("long"))
    axis = axis_number(df, first)
    borders = _borders(sized.select(axis_number(sized, first).alias("_axis")), chunks)
    repeated = sorted({x for x in borders if borders.count(x) > 1}) if len(set(borders)) < len(borders) else []
    tied = _tied_values(sized, first, repeated, rows_per_chunk) if repeated and tie else []
    cut = _bucket(df, axis, borders, "_a")
    place = cut_tie = F.lit(0)
    if tied:
        kind = df.schema[first].dataType
        among = F.filter(F.array(*[F.lit(v).cast(kind) for v in tied]), lambda v: v == F.col(first))
        held = sized.filter(axis_number(sized, first).isin(repeated))
        cut = _bucket(cut, axis_number(df, tie), _borders(held.select(axis_number(held, tie).alias("_axis")), chunks), "_b")
        place = _place_among(F.col(first), tied, kind)
        # a missing tie-breaker comes first, as in the order of the rows
        cut_tie = F.when((F.size(among) > 0) & F.col(tie).isNotNull(), F.col("_b") + 1).otherwise(F.lit(0))
    # never null, like the order of the rows: a missing order value comes first. It also keeps
    # the joins on the number from repeating the cut in a null filter.
    number = F.when(F.col(first).isNotNull(), F.col("_a").cast("long") * VALUE_SPAN + place * TIE_SPAN + cut_tie)
    number = F.coalesce(number, F.lit(-1).cast("long"))
    return cut.withColumn(name, number).drop("_a", "_b")


def _cells(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunking: dict) -> DataFrame:
    """Rows with their cell: chunk number ``_c`` and key struct ``_k``, which replaces the keys.

    A struct is never null and compares null fields as equal, so windows, summaries and the
    join share one hash partitioning without null-safe rewrites. The number comes first
    because it sorts fast.
    """
    cut = with_chunks(df, order, name="_c", **chunking)
    return cut.withColumn("_k", F.struct(*keys)).drop(*keys)


CELL = ["_c", "_k"]


def _across():
    return Window.partitionBy("_k").orderBy("_c")


def _restore(df: DataFrame, like: DataFrame, keys: Sequence[str], name: str, value: Column) -> DataFrame:
    """The columns of the input in their order, and the computed one."""
    columns = [F.col(f"_k.{c}").alias(c) if c in keys else F.col(c) for c in like.columns]
    return df.select(*columns, value.alias(name))


def lag_chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, **chunking
) -> DataFrame:
    """``lag(value)`` per key in the given order, for keys of any size."""
    cells = _cells(df, keys, order, chunking)
    local = Window.partitionBy(*CELL).orderBy(*order)
    inside = cells.withColumn("_lag", F.lag(value).over(local)).withColumn("_rn", F.row_number().over(local))
    last = cells.groupBy(*CELL).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carry = last.select(*CELL, F.lag("_last").over(_across()).alias("_carry"))
    previous = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return _restore(inside.join(carry, CELL), df, keys, name, previous)


def last_known_chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, **chunking
) -> DataFrame:
    """The last ``value`` that is not null, up to and with each row, per key in the given order, for keys of any size.

    A row whose second order column is null comes before the others of its time.
    """
    cells = _cells(df, keys, order, chunking)
    local = Window.partitionBy(*CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cells.withColumn("_seen", F.last(value, ignorenulls=True).over(local))
    ends = cells.filter(F.col(value).isNotNull()).groupBy(*CELL).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    # every cell takes over the last value of the cells before it, also where it has none itself
    places = cells.select(*CELL).distinct().join(ends, CELL, "left")
    before = F.last("_last", ignorenulls=True).over(_across().rowsBetween(Window.unboundedPreceding, -1))
    carry = places.select(*CELL, before.alias("_carry"))
    return _restore(inside.join(carry, CELL), df, keys, name, F.coalesce("_seen", "_carry"))


def running_sum_chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, **chunking
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in the given order, for keys of any size."""
    cells = _cells(df.withColumn("_v", value), keys, order, chunking)
    local = Window.partitionBy(*CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = _across().rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy(*CELL).agg(F.sum("_v").alias("_t"))
    carry = totals.select(*CELL, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    running = cells.withColumn("_run", F.sum("_v").over(local)).join(carry, CELL)
    return _restore(running, df, keys, name, F.col("_run") + F.col("_carry"))


def streak_chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, name: str, **chunking
) -> DataFrame:
    """Length of the run of consecutive hits ending at each row, 0 on a miss.

    Inside a chunk a row's streak is its running hit count minus that count at the latest
    miss. A row before the chunk's first miss also continues the streak carried in, which is
    the sum of the trailing runs of the chunks back to the latest one with a miss.
    """
    cells = _cells(df.withColumn("_h", F.coalesce(hit, F.lit(False)).cast("long")), keys, order, chunking)
    local = Window.partitionBy(*CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = cells.withColumn("_hits", F.sum("_h").over(local))
    based = counted.withColumn("_base", F.max(F.when(F.col("_h") == 0, F.col("_hits"))).over(local))
    tails = based.groupBy(*CELL).agg(F.max("_hits").alias("_total"), F.max("_base").alias("_b")).select(
        *CELL, F.col("_b").isNotNull().cast("long").alias("_miss"),
        (F.col("_total") - F.coalesce("_b", F.lit(0))).alias("_tail"),
    )
    upto = _across().rowsBetween(Window.unboundedPreceding, 0)
    since_miss = Window.partitionBy("_k", "_g").orderBy("_c")
    ends = tails.withColumn("_g", F.sum("_miss").over(upto)).withColumn(
        "_end", F.sum("_tail").over(since_miss.rowsBetween(Window.unboundedPreceding, 0))
    )
    carry = ends.select(*CELL, F.coalesce(F.lag("_end").over(_across()), F.lit(0)).alias("_carry"))
    streak = F.when(F.col("_base").isNotNull(), F.col("_hits") - F.col("_base")).otherwise(
        F.col("_hits") + F.col("_carry")
    )
    return _restore(based.join(carry, CELL), df, keys, name, streak)
