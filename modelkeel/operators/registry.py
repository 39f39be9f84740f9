"""Model registry as append-only tables: versions and alias events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeel.operators.ordered import lag_chunked, last_known_chunked, running_sum_chunked
from modelkeel.schema import columns
from modelkeel.session import broadcast_if_small

CHAMPION, CHALLENGER, PREVIOUS = "champion", "challenger", "previous"

#: Lineage tags copied from the run to the version.
LINEAGE_TAGS = ("data_hash", "git_commit", "reference_uri")

ALIAS_EVENTS = columns(name="string", alias="string", version="integer", ts="timestamp", seq="integer", trigger="string")
MODEL_VERSIONS = columns(
    name="string", version="integer", run_id="string", tags=T.MapType(T.StringType(), T.StringType()), ts="timestamp"
)


def current_aliases(events: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """``name, alias, version``: the last event per alias, as a partially aggregated maximum."""
    return events.groupBy("name", "alias").agg(F.max_by("version", F.struct(*order)).alias("version"))


def champions(events: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    return current_aliases(events.filter(F.col("alias") == CHAMPION), order).drop("alias")


def validity(events: DataFrame, order: Sequence[str] = ("ts", "seq"), alias: str = CHAMPION) -> DataFrame:
    """``name, version, valid_from, valid_to`` of an alias: half-open intervals, the last one open (null).

    Repeated promotions of one version are one interval; several events at one time leave the last one.
    """
    set_to = events.filter(F.col("alias") == alias).groupBy("name", order[0]).agg(F.max_by("version", F.struct(*order)).alias("version"))
    by_time = Window.partitionBy("name").orderBy(order[0])
    changed = set_to.withColumn("_before", F.lag("version").over(by_time)).filter(~F.col("version").eqNullSafe(F.col("_before")))
    return changed.select("name", "version", F.col(order[0]).alias("valid_from"), F.lead(order[0]).over(by_time).alias("valid_to"))


def champion_as_of(records: DataFrame, events: DataFrame, *, order: Sequence[str] = ("ts", "seq"), at: Sequence[str] = ("ts", "id"), **chunking) -> DataFrame:
    """``records`` (with ``name``) and ``champion``: the version that was champion when each record was made.

    An event counts for records of its own time and later ones; records before the first event have a null.
    Events and records are put into one order, and the last event is carried to the records after it, across chunks of
    bounded size: a model with most of the records is many tasks' work, and no record is compared with each interval.
    """
    promoted = events.filter(F.col("alias") == CHAMPION)
    columns_ = [F.col(c) for c in records.columns]
    kind = records.schema[at[1]].dataType
    mine = records.select("name", F.col(at[0]).alias("_ts"), F.col(at[1]).alias("_id"), F.struct(*columns_).alias("_record"))
    # events of one time come before its records, the last of them last
    theirs = promoted.groupBy("name", F.col(order[0]).alias("_ts")).agg(F.max_by("version", F.struct(*order)).alias("_version"))
    theirs = theirs.select("name", "_ts", F.lit(None).cast(kind).alias("_id"), "_version")
    line = mine.unionByName(theirs, allowMissingColumns=True)
    known = last_known_chunked(line, ["name"], ["_ts", "_id"], "_version", "champion", **chunking)
    return known.filter(F.col("_record").isNotNull()).select("_record.*", "champion")


def previous_champion(promotions: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """``name, champion, previous`` from champion events alone.

    The champion is the version with the latest promotion, the previous one the version with
    the second latest: repeated promotions of one version collapse first, and the
    ``row_number`` limit is applied before the shuffle.
    """
    latest = promotions.groupBy("name", "version").agg(F.max(F.struct(*order)).alias("at"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("at")))
    top = latest.withColumn("r", rank).filter("r <= 2")
    return top.groupBy("name").agg(
        F.max(F.when(F.col("r") == 1, F.col("version"))).alias("champion"),
        F.max(F.when(F.col("r") == 2, F.col("version"))).alias("previous"),
    )


def promotion_events(promotions: DataFrame, order: Sequence[str], initial: DataFrame | None = None) -> DataFrame:
    """Alias events of a batch of promotions ``name, version, trigger, <order>``.

    Every promotion sets ``champion``; it sets ``previous`` to the outgoing champion when
    that is another version. ``initial`` holds the champions before the batch.
    """
    known = lag_chunked(promotions, ["name"], order, "version", "old")
    if initial is not None:
        before = broadcast_if_small(initial.select("name", F.col("version").alias("initial")))
        known = known.join(before, "name", "left").withColumn("old", F.coalesce("old", "initial")).drop("initial")
    changed = F.col("old").isNotNull() & (F.col("old") != F.col("version"))
    events = F.array_compact(
        F.array(
            F.when(changed, F.struct(F.lit(PREVIOUS).alias("alias"), F.col("old").alias("target"), F.lit(0).alias("seq"))),
            F.struct(F.lit(CHAMPION).alias("alias"), F.col("version").alias("target"), F.lit(1).alias("seq")),
        )
    )
    return known.select("name", *order, "trigger", F.inline(events)).withColumnRenamed("target", "version")


def rollback_targets(events: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """``name, champion, version, trigger, error``: promote what ``previous`` names, if anything."""
    aliases = current_aliases(events, order).groupBy("name").agg(
        F.max(F.when(F.col("alias") == CHAMPION, F.col("version"))).alias("champion"),
        F.max(F.when(F.col("alias") == PREVIOUS, F.col("version"))).alias("version"),
    )
    nothing = F.col("version").isNull()
    return aliases.withColumn("trigger", F.when(~nothing, F.lit("rollback"))).withColumn(
        "error", F.when(nothing, F.lit("no previous champion"))
    )


def next_versions(new_runs: DataFrame, order: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """Number the new runs of each ``name`` after its highest existing version, in order."""
    numbered = running_sum_chunked(new_runs, ["name"], order, F.lit(1), "version")
    if existing is None:
        return numbered
    highest = existing.groupBy("name").agg(F.max("version").alias("_top"))
    joined = numbered.join(broadcast_if_small(highest), "name", "left")
    return joined.withColumn("version", F.col("version") + F.coalesce("_top", F.lit(0))).drop("_top")


def with_lineage(versions: DataFrame, runs: DataFrame, tags: Sequence[str] = LINEAGE_TAGS) -> DataFrame:
    """Copy lineage tags from ``runs(run_id, tags)``; a missing run or tag is an empty text.

    Both sides grow with the history, so this is a shuffled join; AQE splits a hot run id.
    """
    side = runs.select("run_id", *[F.col("tags").getItem(t).alias(t) for t in tags])
    joined = versions.join(side, "run_id", "left")
    return joined.withColumns({t: F.coalesce(F.col(t), F.lit("")) for t in tags})


def serving_uri(root: str, use_case: Column, model: Column, version: Column) -> Column:
    return F.concat_ws("/", F.lit(root), use_case, model, F.concat(F.lit("v"), version.cast("string")))


def latest_runs(runs: DataFrame, created: Sequence[str], n: int) -> DataFrame:
    """The ``n`` newest runs (a report, so a top-k)."""
    return runs.orderBy(*[F.desc(c) for c in created]).limit(n)


#: Phases of a run that is still in flight.
IN_FLIGHT = ("", "Pending", "Running")


def retrain_requests(levels: DataFrame, runs: DataFrame) -> DataFrame:
    """Models whose drift level asks for a retrain and that have no run in flight."""
    busy = runs.filter(F.coalesce("phase", F.lit("")).isin(*IN_FLIGHT)).select("use_case", "model").distinct()
    wanted = levels.filter(F.col("level") == "retrain")
    return wanted.join(broadcast_if_small(busy), ["use_case", "model"], "left_anti")
