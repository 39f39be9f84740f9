"""Population Stability Index per column, per model and per sliding window.

Two scans per report: a profile (row counts, extremes, distinct-value sketch; one row per
model) and one binning pass whose counts are partially aggregated before the only shuffle,
so neither a hot model nor a hot value concentrates rows in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeel.functions.vectors import category, coerce_number
from modelkeel.operators.quality import shared_columns
from modelkeel.session import broadcast_if_small, materialise

#: Floor of a bin share, distinct values up to which a number is binned by
#: value, policy thresholds (strict), guard and cadence of the monitor.
SHARE_FLOOR = 1e-4
MAX_VALUE_BINS = 20
WARN, RETRAIN = 0.2, 0.3
MIN_ROWS = 200
WINDOW_MINUTES, SLIDE_MINUTES = 30, 10
PREDICTION = "prediction"

REFERENCE, LIVE = "ref", "live"


def numeric_columns(reference: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns compared as numbers; booleans and texts are categories."""
    return [c for c in columns if isinstance(reference.schema[c].dataType, T.NumericType)]


def _normalised(df: DataFrame, by: Sequence[str], columns: Sequence[str], numeric: Sequence[str], side: str) -> DataFrame:
    """Keys, side, and every column as a double (numeric) or category text."""
    picked = [
        (coerce_number(F.col(c)) if c in numeric else category(F.col(c))).alias(c) for c in columns
    ]
    return df.select(*by, F.lit(side).alias("side"), *picked)


def sturges_bins(rows: Column) -> Column:
    return F.ceil(F.log2(rows) + 1)


def _profile(both: DataFrame, by: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """One row per key: rows per side and, per numeric column, extremes and a sketch."""
    is_ref = F.col("side") == REFERENCE
    aggregates = [
        F.sum(is_ref.cast("long")).alias("n_ref"), F.sum((~is_ref).cast("long")).alias("n_live"),
    ]
    for c in numeric:
        aggregates += [
            F.min(c).alias(f"lo:{c}"), F.max(c).alias(f"hi:{c}"),
            F.approx_count_distinct(F.when(is_ref, F.col(c))).alias(f"nd:{c}"),
        ]
    return both.groupBy(*by).agg(*aggregates)


def _few_valued(both: DataFrame, by: Sequence[str], numeric: Sequence[str], profile: DataFrame) -> DataFrame:
    """``by…, column`` whose reference has at most MAX_VALUE_BINS values, counted exactly.

    Sketches far above the limit settle the clear cases. The rest have few distinct values,
    so counting them exactly aggregates to a handful of rows per task.
    """
    sketch = profile.select(*by, *[F.col(f"nd:{c}") for c in numeric])
    ref = both.filter(F.col("side") == REFERENCE).join(sketch, list(by))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v"), F.col(f"nd:{c}").alias("nd")) for c in numeric])
    unsure = F.filter(cells, lambda x: (x["nd"] <= 3 * MAX_VALUE_BINS) & x["v"].isNotNull())
    distinct = ref.select(*by, F.inline(unsure)).groupBy(*by, "column", "v").agg(F.count(F.lit(1)).alias("n"))
    counted = distinct.groupBy(*by, "column").agg(F.count(F.lit(1)).alias("d"))
    return counted.filter(F.col("d") <= MAX_VALUE_BINS).select(*by, "column", F.lit(True).alias("few"))


def _bin_plan(both: DataFrame, by: Sequence[str], columns: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """``by…, n_ref, n_live, column, lo, width, k`` as a written table; ``k`` null: bin by value.

    One row per key and column, computed without the driver; written, so that the pass over the
    rows joins a table of known size and Spark can choose how.
    """
    keys = list(by) or ["_all"]
    if not by:
        both = both.withColumn("_all", F.lit(0))
    profile = _profile(both, keys, numeric)
    none = F.lit(None).cast("double")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(f"lo:{c}") if c in numeric else none).alias("lo"), (F.col(f"hi:{c}") if c in numeric else none).alias("hi"))
        for c in columns
    ])
    plan = profile.select(*keys, "n_ref", "n_live", F.inline(cells))
    few = _few_valued(both, keys, numeric, profile) if numeric else None
    plan = plan.withColumn("few", F.lit(None)) if few is None else plan.join(few, [*keys, "column"], "left")
    rows = F.col("n_ref") + F.col("n_live")
    wanted = F.when(rows <= 1, 1).otherwise(F.length(F.bin(rows - 1)) + 1)  # ceil(log2(rows)) + 1, exactly
    k = F.when(F.col("few").isNull() & (F.col("hi") > F.col("lo")), wanted).cast("int")
    sized = plan.withColumn("k", k).withColumn("width", F.when(F.col("k").isNotNull(), (F.col("hi") - F.col("lo")) / F.col("k")))
    return materialise(sized.select(*by, "n_ref", "n_live", "column", F.when(F.col("k").isNotNull(), F.col("lo")).alias("lo"), "width", "k"), "bin-plan")


def equal_width_bin(value: Column, lo: Column, width: Column, k: Column) -> Column:
    """Bin number 0…k-1; values outside the edges fall into the outer bins, null has none."""
    raw = F.floor((value - lo) / width)
    clamped = F.greatest(F.least(raw, k.cast("long") - 1), F.lit(0).cast("long"))
    return F.when(value.isNotNull(), clamped)  # least and greatest would skip the null


def _bin_text() -> Column:
    """Bin of a cell ``num`` or ``text`` under the plan ``lo, width, k``; only bins become text."""
    by_value = F.coalesce("text", F.col("num").cast("string"))
    number = equal_width_bin(F.col("num"), F.col("lo"), F.col("width"), F.col("k"))
    return F.when(F.col("k").isNull(), by_value).otherwise(number.cast("string"))


def psi_term(n_ref: Column, rows_ref: Column, n_live: Column, rows_live: Column) -> Column:
    p = F.greatest(n_ref / rows_ref, F.lit(SHARE_FLOOR))
    q = F.greatest(n_live / rows_live, F.lit(SHARE_FLOOR))
    return (p - q) * F.log(p / q)


def psi_by_column(
    reference: DataFrame, live: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``by…, column, bins, n_ref, n_live, psi`` for every column, all models in one job.

    Numbers with more than 20 reference values: equal-width bins over both sides, their
    number by Sturges' rule. Other numbers and categories: one bin per value. A null is a
    category of its own; numeric nulls have no bin but count in the denominator. A model
    with rows on one side only has no PSI and is left out.
    """
    numeric = numeric_columns(reference, columns)
    both = _normalised(reference, by, columns, numeric, REFERENCE).unionByName(
        _normalised(live, by, columns, numeric, LIVE)
    )
    plan = _bin_plan(both, by, columns, numeric)
    if not by:
        both, plan = both.withColumn("_all", F.lit(0)), plan.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            (F.col(c) if c in numeric else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if c in numeric else F.col(c)).alias("text"),
        ) for c in columns
    ])
    long = both.select(*keys, "side", F.inline(cells)).join(plan, [*keys, "column"])
    binned = long.withColumn("bin", _bin_text())
    counts = binned.groupBy(*keys, "column", "n_ref", "n_live", "bin").agg(
        F.sum((F.col("side") == REFERENCE).cast("long")).alias("c_ref"),
        F.sum((F.col("side") == LIVE).cast("long")).alias("c_live"),
    )
    usable = counts.filter("n_ref > 0 AND n_live > 0")
    term = F.when(F.col("bin").isNotNull(), psi_term(F.col("c_ref"), F.col("n_ref"), F.col("c_live"), F.col("n_live")))
    scored = usable.groupBy(*keys, "column", "n_ref", "n_live").agg(
        F.count("bin").alias("bins"), F.coalesce(F.sum(term), F.lit(0.0)).alias("psi")
    )
    return scored.select(*by, "column", "bins", "n_ref", "n_live", "psi")


def level(worst: Column, warn: float = WARN, retrain: float = RETRAIN) -> Column:
    """``retrain``, ``warn`` or ``ok``; a value exactly on a threshold stays below it."""
    return F.when(worst > retrain, F.lit("retrain")).when(worst > warn, F.lit("warn")).otherwise(F.lit("ok"))


def drift_levels(report: DataFrame, by: Sequence[str], warn: float = WARN, retrain: float = RETRAIN) -> DataFrame:
    worst = report.groupBy(*by).agg(F.max("psi").alias("max_psi"), F.max("n_live").alias("n_live"))
    return worst.withColumn("level", level(F.col("max_psi"), warn, retrain))


def recent(df: DataFrame, now: Column, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Rows of the last ``minutes`` before ``now``; there is no upper bound."""
    return df.filter(F.col("ts") >= now - F.make_dt_interval(mins=F.lit(minutes)))


def champion_rows(live: DataFrame, champions: DataFrame, keys: Sequence[str] = ("use_case", "model")) -> DataFrame:
    """Only rows answered by the current champion; versions compare as text.

    One row per model on the champion side; broadcast only after counting it.
    """
    side = champions.select(*keys, F.col("version").cast("string").alias("model_version"))
    versioned = live.withColumn("model_version", F.col("model_version").cast("string"))
    return versioned.join(broadcast_if_small(side), [*keys, "model_version"], "left_semi")


def as_prediction(reference: DataFrame, live: DataFrame, target: str, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rename the reference's target to ``prediction`` and compare it too, if both sides can."""
    chosen = shared_columns(tuple(columns), reference, live)
    if target in reference.columns and PREDICTION in live.columns:
        return reference.withColumnRenamed(target, PREDICTION), [*chosen, PREDICTION]
    return reference, chosen


def skip_reasons(
    models: DataFrame, champions: DataFrame, references: DataFrame, live_rows: DataFrame,
    comparable: int, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """``use_case, model, rows, skipped``: why a model is not judged; null when it is.

    All sides have one row per model; ``live_rows`` has the count ``n``.
    """
    keys = ["use_case", "model"]
    joined = (
        models.select(*keys)
        .join(champions.select(*keys, F.lit(True).alias("has_champion")), keys, "left")
        .join(references.select(*keys, F.lit(True).alias("has_reference")), keys, "left")
        .join(live_rows.select(*keys, F.col("n").alias("rows")), keys, "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    )
    too_few = (F.col("rows") < min_rows) | F.lit(comparable == 0)
    reason = (
        F.when(F.col("has_champion").isNull(), F.lit("no champion yet"))
        .when(F.col("has_reference").isNull(), F.lit("champion has no reference"))
        .when(too_few, F.format_string("%d rows < %d or no comparable columns", F.col("rows"), F.lit(min_rows)))
    )
    return joined.select(*keys, "rows", reason.alias("skipped"))


# --- sliding windows against bins frozen with the reference --------------------------------


def reference_bins(reference: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Freeze the bins of a reference: ``(edges, shares)``.

    ``edges`` has one row per model and column (local table), ``shares`` the reference count
    of every bin. Windows of live data are compared with these, whatever their own range.
    """
    numeric = numeric_columns(reference, columns)
    ref = _normalised(reference, by, columns, numeric, REFERENCE)
    edges = _bin_plan(ref, by, columns, numeric).drop("n_live")
    counts = bin_counts(ref, edges, columns, by, numeric).withColumnRenamed("n", "c_ref")
    return edges, counts


def bin_counts(
    df: DataFrame, edges: DataFrame, columns: Sequence[str], by: Sequence[str], numeric: Sequence[str],
    extra: Sequence[str] = (),
) -> DataFrame:
    """Rows per ``extra…, by…, column, bin``; works on streams as well as on tables."""
    return _to_bins(df, edges, columns, by, numeric, extra).groupBy(*extra, *by, "column", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )


def _to_bins(df, edges, columns, by, numeric, extra=()) -> DataFrame:
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            (coerce_number(F.col(c)) if c in numeric else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if c in numeric else category(F.col(c))).alias("text"),
        ) for c in columns
    ])
    long = df.select(*extra, *by, F.inline(cells)).join(edges, [*by, "column"])
    return long.withColumn("bin", _bin_text())


def live_panes(
    live: DataFrame, edges: DataFrame, columns: Sequence[str], by: Sequence[str], numeric: Sequence[str], pane: str,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Counts per pane (the slide length), key, column and bin: the only pass over live rows."""
    stamped = live.withColumn("pane", F.window("ts", pane).getField("start"))
    return bin_counts(stamped, edges, columns, by, numeric, ("pane", *extra))


def window_psi(
    panes: DataFrame, edges: DataFrame, reference_counts: DataFrame, by: Sequence[str], ref_by: Sequence[str],
    *, window: str, slide: str, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Slide windows over pane counts: ``window_start, window_end, by…, column, n_live, psi, skipped``.

    Only counts are replicated into the overlapping windows, never rows. A window below
    ``min_rows`` keeps its row with ``skipped`` set and no PSI.
    """
    spread = panes.withColumn("w", F.window("pane", window, slide)).withColumn("window_start", F.col("w.start")).withColumn(
        "window_end", F.col("w.end")
    )
    live = spread.groupBy("window_start", "window_end", *by, "column", "bin").agg(F.sum("n").alias("c_live"))
    return psi_of_counts(live, edges, reference_counts, ["window_start", "window_end", *by], ref_by, min_rows=min_rows)


def psi_of_counts(
    live: DataFrame, edges: DataFrame, reference_counts: DataFrame, keys: Sequence[str], ref_by: Sequence[str],
    *, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """PSI of live bin counts ``keys…, column, bin, c_live`` against frozen reference counts.

    Bins the live side did not hit follow from the totals: every group contributes the terms
    of its own bins, and the missing reference bins contribute the sum of all their
    floor-share terms minus those already matched.
    """
    sizes = edges.select(*ref_by, "column", "n_ref")
    known = reference_counts.filter("bin IS NOT NULL")
    absent_term = psi_term(F.col("c_ref"), F.col("n_ref"), F.lit(0), F.lit(1))
    unmatched = known.join(sizes, [*ref_by, "column"]).groupBy(*ref_by, "column").agg(F.sum(absent_term).alias("all_absent"))
    totals = live.groupBy(*keys, "column").agg(F.sum("c_live").alias("n_live"))
    matched = (
        live.join(known, [*ref_by, "column", "bin"], "left").join(sizes, [*ref_by, "column"])
        .join(totals, [*keys, "column"])
        .withColumn("c_ref", F.coalesce("c_ref", F.lit(0)))
    )
    own = F.when(F.col("bin").isNotNull(), psi_term(F.col("c_ref"), F.col("n_ref"), F.col("c_live"), F.col("n_live")))
    absent = F.when(F.col("bin").isNotNull() & (F.col("c_ref") > 0), absent_term)
    per_column = matched.groupBy(*keys, "column", "n_ref", "n_live").agg(
        F.coalesce(F.sum(own), F.lit(0.0)).alias("own"), F.coalesce(F.sum(absent), F.lit(0.0)).alias("matched_absent")
    )
    joined = per_column.join(unmatched, [*ref_by, "column"], "left")
    psi = F.col("own") + F.coalesce("all_absent", F.lit(0.0)) - F.col("matched_absent")
    few = F.col("n_live") < min_rows
    return joined.select(
        *keys, "column", "n_live", F.when(~few, psi).alias("psi"),
        F.when(few, F.format_string("%d rows < %d", F.col("n_live"), F.lit(min_rows))).alias("skipped"),
    )
