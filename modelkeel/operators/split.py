"""Reproducible exact splits and frozen samples without sorting the data.

Rows are ordered by the md5 of seed and row key, as if shuffled. "The first k rows of that
order" is found by selection instead of a sort: count rows per stratum and hash prefix
(partially aggregated, at most 65 536 counts per stratum), find the prefix in which the
quota falls, rank only that prefix's rows, and read off one threshold hash per stratum.
Labelling the rows is then a comparison with the threshold, without a shuffle, so a stratum
that holds most of the table costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeel.functions.ids import order_hash
from modelkeel.session import broadcast_if_small

#: Default share of the holdout, size of the frozen reference,
#: and the most distinct values of a numeric target that is still a class label.
HOLDOUT_RATIO = 0.25
REFERENCE_ROWS = 2000
MAX_NUMERIC_CLASSES = 20
#: Hex digits of the hash prefix used for selection.
PREFIX = 4


def stratify_decision(df: DataFrame, target: str) -> DataFrame:
    """``target, is_numeric, distinct_values, stratify`` in one row.

    A non-numeric target, or a numeric one with at most 20 values, is stratified when it has
    more than one value.
    """
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    counted = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    few = F.lit(True) if not numeric else F.col("distinct_values") <= MAX_NUMERIC_CLASSES
    return counted.agg(F.count(F.lit(1)).alias("distinct_values")).select(
        F.lit(target).alias("target"), F.lit(numeric).alias("is_numeric"), "distinct_values",
        (few & (F.col("distinct_values") > 1)).alias("stratify"),
    )


def _should_stratify(df: DataFrame, target: str) -> bool:
    """The decision with an early exit: a sketch settles clearly continuous targets."""
    if isinstance(df.schema[target].dataType, T.NumericType):
        sketched = df.agg(F.approx_count_distinct(target)).first()[0]
        if sketched > 4 * MAX_NUMERIC_CLASSES:
            return False
    return stratify_decision(df, target).first()["stratify"]


def _first_k_thresholds(hashed: DataFrame, quota_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``s, threshold``: the hash of the last row of the first ``quota`` rows of each stratum.

    ``hashed`` has ``s`` (a non-null struct naming the stratum) and ``h``; ``quota_of`` turns
    the sizes ``s, rows`` into ``s, quota``. Sizes and prefixes come from the same counts, so
    one scan finds the edge and a second ranks the few rows around it.
    """
    prefixed = hashed.select("s", "h", F.substring("h", 1, PREFIX).alias("p"))
    counts = prefixed.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))
    quotas = quota_of(counts.groupBy("s").agg(F.sum("n").alias("rows"))).filter("quota > 0").select("s", "quota")
    upto = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.withColumn("c", F.sum("n").over(upto)).join(quotas, "s")
    edge = cumulated.filter((F.col("c") >= F.col("quota")) & (F.col("c") - F.col("n") < F.col("quota")))
    edge = edge.select("s", "p", (F.col("quota") - F.col("c") + F.col("n")).alias("take"))
    candidates = prefixed.join(broadcast_if_small(edge), ["s", "p"])
    rank = F.row_number().over(Window.partitionBy("s", "p").orderBy("h"))
    ranked = candidates.withColumn("r", rank).filter(F.col("r") == F.col("take"))
    return ranked.select("s", F.col("h").alias("threshold"))


def stratum_quotas(sizes: DataFrame, ratio: float) -> DataFrame:
    """``s, rows, quota`` from ``s, rows``: ``ceil(rows * ratio)`` in total, by largest remainder.

    One row per stratum; a stratum is a class of the target, so this table is small.
    """
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("rows").over(everything)
    wanted = F.ceil(F.round(total * ratio, 6))
    share = wanted * F.col("rows") / total
    based = sizes.withColumn("wanted", wanted).withColumn("base", F.floor(share).cast("long")).withColumn(
        "rest", F.round(share - F.floor(share), 9)
    )
    order = F.row_number().over(everything.orderBy(F.desc("rest"), "s"))
    extra = (order <= F.col("wanted") - F.sum("base").over(everything)).cast("long")
    return based.withColumn("quota", F.col("base") + extra).select("s", "rows", "quota")


def with_holdout(
    df: DataFrame, key: Sequence[str], *, seed: int, ratio: float = HOLDOUT_RATIO, strata: Sequence[str] = ()
) -> DataFrame:
    """Add ``is_holdout``: exactly the quota of every stratum, by hash order of the row key.

    ``key`` has to identify a row.
    """
    s = F.struct(*strata) if strata else F.struct(F.lit(0).alias("a"))
    hashed = df.withColumn("h", order_hash(seed, *key)).withColumn("s", s)
    thresholds = _first_k_thresholds(hashed.select("s", "h"), lambda sizes: stratum_quotas(sizes, ratio))
    labelled = hashed.join(broadcast_if_small(thresholds), "s", "left")
    inside = F.coalesce(F.col("h") <= F.col("threshold"), F.lit(False))
    return labelled.withColumn("is_holdout", inside).drop("s", "h", "threshold")


def train_holdout(
    df: DataFrame, target: str, key: Sequence[str], *, seed: int, ratio: float = HOLDOUT_RATIO
) -> tuple[DataFrame, DataFrame]:
    """``(train, holdout)``, stratified on the target when it is a class label."""
    strata = (target,) if _should_stratify(df, target) else ()
    marked = with_holdout(df, key, seed=seed, ratio=ratio, strata=strata)
    return marked.filter(~F.col("is_holdout")).drop("is_holdout"), marked.filter("is_holdout").drop("is_holdout")


def frozen_sample(df: DataFrame, key: Sequence[str], rows: int = REFERENCE_ROWS, *, seed: int) -> DataFrame:
    """``min(rows, all)`` rows in hash order, without replacement, for any ``rows``."""
    hashed = df.withColumn("h", order_hash(seed, *key)).withColumn("s", F.struct(F.lit(0).alias("a")))
    thresholds = _first_k_thresholds(
        hashed.select("s", "h"), lambda sizes: sizes.withColumn("quota", F.least(F.lit(rows), F.col("rows")))
    )
    kept = hashed.join(broadcast_if_small(thresholds), "s").filter(F.col("h") <= F.col("threshold"))
    return kept.drop("s", "h", "threshold")


def sample_records(df: DataFrame, features: Sequence[str], key: Sequence[str], rows: int, *, seed: int) -> DataFrame:
    """``rows`` feature records as JSON, in hash order (a printed sample, so a top-k)."""
    return (
        df.withColumn("h", order_hash(seed, *key)).orderBy("h").limit(rows)
        .select(F.to_json(F.struct(*features)).alias("record"))
    )


def cap_rows(df: DataFrame, key: Sequence[str], rows: int | None, *, seed: int) -> DataFrame:
    """Ingest exactly ``min(rows, all)`` rows; which ones depends on the seed only.

    Rows of one key are equal; where the cut falls among them, one of them is repeated as often as needed.
    """
    if rows is None:
        return df
    kept = frozen_sample(df, key, rows, seed=seed).withColumn("_h", order_hash(seed, *key))
    last = kept.agg(F.max("_h")).first()[0]
    if last is None:
        return kept.drop("_h")
    before, edge = kept.filter(F.col("_h") < last), kept.filter(F.col("_h") == last)
    left = min(rows - before.count(), edge.count())
    repeated = edge.limit(1).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(left)))).drop("_n") if left else edge.limit(0)
    return before.unionByName(repeated).drop("_h")


def category_share(df: DataFrame, category: Column) -> DataFrame:
    """Share of the rows for which ``category`` holds; null does not."""
    return df.agg(F.avg(F.coalesce(category, F.lit(False)).cast("double")).alias("share"))
