"""Trailing ranges on a grid of evaluation times: sliding sums, counter increases, instant values, series matching.

An evaluation at time t sees the samples of (t - range, t]. Samples are first added up by pane, the grid step that
ends at the first evaluation that sees them; this is the only pass over raw rows, and its partial sums leave the task
as one row a key and pane. Evaluations then slide over the panes: each pane stands for the grid times up to the next
one, and windows with a range frame add up whatever lies in reach, for several ranges at once. Where no pane is in
reach there is no row: an absent evaluation stays absent, as a rule would see it.

The windows see a block of time of one key, not its whole history. Panes near the end of a block are seen by the
next one too, so a single key with a long history is spread over tasks like many keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelkeel.operators.ordered import lag_chunked

#: Evaluations of one key that a window holds at a time.
BLOCK_STEPS = 20_000
#: Fixed value: seconds after which the last sample of a series is no longer its value.
STALENESS = 300


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def evaluation(ts: str, step: int) -> Column:
    """The first grid time (seconds, a multiple of ``step``) that is not before ``ts``, in whole numbers."""
    micros, size = _micros(ts), F.lit(step * 1_000_000)
    return ((micros + F.pmod(-micros, size)) / 1_000_000).cast("long")


def panes(df: DataFrame, by: Sequence[str], step: int, ts: str = "ts", /, **aggregates: Column) -> DataFrame:
    """``by…, t`` and the aggregates of the samples whose first evaluation is ``t``."""
    return df.groupBy(*by, evaluation(ts, step).alias("t")).agg(*[c.alias(name) for name, c in aggregates.items()])


def _evaluated(cells: DataFrame, by: Sequence[str], step: int, longest: int) -> DataFrame:
    """One row an evaluation and block, with the pane that ends there, if any, as ``pane``."""
    length = max(BLOCK_STEPS * step, longest)
    block = lambda t: F.floor(t / length)
    values = [c for c in cells.columns if c not in (*by, "t")]
    kept = cells.select(*by, "t", F.struct(*values).alias("pane"))
    spread = kept.withColumn("block", F.explode(F.array_distinct(F.array(block(F.col("t")), block(F.col("t") + longest - step)))))
    following = F.lead("t").over(Window.partitionBy(*by, "block").orderBy("t"))
    last = F.least(F.col("t") + longest - step, (F.col("block") + 1) * length - 1, F.coalesce(following - step, F.col("t") + longest))
    times = F.sequence(F.col("t"), F.greatest(last, F.col("t")), F.lit(step).cast("long"))
    dense = spread.withColumn("times", times).select(*by, "block", "t", "pane", F.explode("times").alias("at"))
    return dense.select(*by, "block", F.col("at").alias("t"), F.when(F.col("at") == F.col("t"), F.col("pane")).alias("pane"),
                        (F.col("block") == block(F.col("at"))).alias("own"))


def trailing(
    cells: DataFrame, by: Sequence[str], step: int, ranges: Sequence[int], *, sums: Sequence[str] = (), firsts: Sequence[str] = (),
    lasts: Sequence[str] = (),
) -> DataFrame:
    """``by…, t, range`` and the columns of the panes in (t - range, t], for every grid time that has one in reach.

    ``sums`` are added up, ``firsts`` and ``lasts`` are those of the earliest and the latest pane. Ranges (seconds) are
    multiples of the step. Null keys are keys of their own.
    """
    if any(r % step or r <= 0 for r in ranges):
        raise ValueError(f"ranges {list(ranges)} must be multiples of the step {step}")
    dense = _evaluated(cells, by, step, max(ranges))
    order = Window.partitionBy(*by, "block").orderBy("t")

    def seen(r: int) -> Column:
        frame = order.rangeBetween(step - r, 0)
        columns = [F.lit(r).cast("long").alias("range"), F.count("pane").over(frame).alias("_n")]
        columns += [F.sum(f"pane.{c}").over(frame).alias(c) for c in sums]
        # struct fields would lose the pane if one of them is null, so the pane is taken as a whole
        columns += [F.first("pane", ignorenulls=True).over(frame)[c].alias(c) for c in firsts]
        columns += [F.last("pane", ignorenulls=True).over(frame)[c].alias(c) for c in lasts]
        return F.struct(*columns)

    named = dense.select(*by, "t", "own", *[seen(r).alias(f"_r{i}") for i, r in enumerate(ranges)]).where("own")
    rows = named.select(*by, "t", F.inline(F.array(*[F.col(f"_r{i}") for i in range(len(ranges))])))
    return rows.where("_n > 0").drop("_n")


def trailing_ratio(calls: DataFrame, hit: Column, by: Sequence[str], step: int, ranges: Sequence[int], ts: str = "ts") -> DataFrame:
    """``by…, t, range, calls, hits, ratio``: share of calls with ``hit`` (null counts as none) in each trailing range."""
    cells = panes(calls, by, step, ts, calls=F.count(F.lit(1)), hits=F.sum(F.coalesce(hit, F.lit(False)).cast("long")))
    return trailing(cells, by, step, ranges, sums=["calls", "hits"]).withColumn("ratio", F.col("hits") / F.col("calls"))


def counter_panes(samples: DataFrame, series: Sequence[str], step: int, *, order: Sequence[str] = ("ts", "id"), value: str = "value", **chunking) -> DataFrame:
    """Panes of counters: number of samples, reset-corrected growth, and the ends of what was seen.

    A value below its predecessor means a restart from zero. ``entering`` is the growth from the pane before, which
    does not count for a range that begins with this pane.
    """
    known = lag_chunked(samples, series, order, value, "_previous", **chunking)
    now, before = F.col(value), F.col("_previous")
    grown = F.when(before.isNull(), F.lit(0)).when(now < before, now).otherwise(now - before)
    staged = known.withColumn("_grown", grown).withColumn("_at", _micros(order[0]))
    place = F.struct(*order)
    return panes(staged, series, step, order[0], samples=F.count(F.lit(1)), growth=F.sum("_grown"), entering=F.min_by("_grown", place),
                 first_value=F.min_by(value, place), first_at=F.min("_at"), last_at=F.max("_at"))


def trailing_increase(samples: DataFrame, series: Sequence[str], step: int, ranges: Sequence[int], *, order: Sequence[str] = ("ts", "id"),
                      value: str = "value", **chunking) -> DataFrame:
    """``series…, t, range, samples, raw, increase, rate`` of counters, for ranges that hold two samples at least.

    ``raw`` is the growth between the first and the last sample in the range, corrected for resets. ``increase``
    carries it on to the bounds of the range: to a bound less than 1.1 mean distances away entirely, else by half a
    mean distance, and to the start no further than where the counter would have been zero. ``rate`` is the
    increase a second. Samples that share one time give no increase.
    """
    cells = counter_panes(samples, series, step, order=order, value=value, **chunking)
    seen = trailing(cells, series, step, ranges, sums=["samples", "growth"], firsts=["entering", "first_value", "first_at"], lasts=["last_at"])
    seen = seen.where("samples > 1").withColumn("raw", F.col("growth") - F.col("entering"))
    end, start = F.col("t") * 1e6, (F.col("t") - F.col("range")) * 1e6
    spent = (F.col("last_at") - F.col("first_at")).cast("double")
    mean = spent / (F.col("samples") - 1)
    to_bound = lambda gap: F.when(gap >= mean * 1.1, mean / 2).otherwise(gap)
    zero = F.when((F.col("raw") > 0) & (F.col("first_value") >= 0), spent * F.col("first_value") / F.col("raw"))
    before = F.least(to_bound(F.col("first_at") - start), zero)  # a null is left out of account
    after = to_bound(end - F.col("last_at"))
    increase = F.when(spent > 0, F.col("raw") * (spent + before + after) / spent)
    return seen.select(*series, "t", "range", "samples", "raw", increase.alias("increase"), (increase / F.col("range")).alias("rate"))


def instant(samples: DataFrame, series: Sequence[str], step: int, *, staleness: int = STALENESS, order: Sequence[str] = ("ts", "id"),
            value: str = "value") -> DataFrame:
    """``series…, t, value``: the last sample of each series that is at most ``staleness`` seconds old, on the grid."""
    cells = panes(samples, series, step, order[0], value=F.max_by(value, F.struct(*order)))
    return trailing(cells, series, step, [staleness], lasts=["value"]).drop("range")


def sum_by(vector: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Series added up by some of their labels, evaluation by evaluation; null values are absent ones."""
    at = [c for c in ("t", "range") if c in vector.columns]
    return vector.where(F.col(value).isNotNull()).groupBy(*at, *by).agg(F.sum(value).alias(value))


def matched_ratio(numerator: DataFrame, denominator: DataFrame, on: Sequence[str], value: str, name: str = "ratio") -> DataFrame:
    """``t, range, on…, above, below, ratio`` where both sides have a value: what one side lacks is left out.

    Labels match as they are, null with null. Both sides are small next to their samples; the join is shuffled by time and
    labels, so no label is hot. A zero below gives null.
    """
    at = [c for c in ("t", "range") if c in numerator.columns]
    left = numerator.select(*at, *on, F.col(value).alias("above")).alias("l")
    right = denominator.select(*at, *on, F.col(value).alias("below")).alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*at, *on)])
    joined = left.join(right, same)
    ratio = F.col("above") / F.nullif(F.col("below"), F.lit(0))
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in (*at, *on)], "above", "below", ratio.alias(name))


def bucket_rates(samples: DataFrame, series: Sequence[str], by: Sequence[str], step: int, ranges: Sequence[int], *, bound: str = "le",
                 order: Sequence[str] = ("ts", "id"), value: str = "value", **chunking) -> DataFrame:
    """``by…, t, range, le, n``: rates of bucket counters, resets corrected for each series and bound, added up by labels.

    This is what :func:`modelkeel.operators.histograms.histogram_quantiles` takes, with ``t`` and ``range`` among its
    keys. The bounds of one series may have been scraped apart, so that a higher bound can show less than a lower one;
    the quantiles repair that.
    """
    rates = trailing_increase(samples, [*series, bound], step, ranges, order=order, value=value, **chunking)
    return sum_by(rates, [*by, bound], "rate").withColumnRenamed("rate", "n")
