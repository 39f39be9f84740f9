"""Streaming jobs run over the whole event table and read back; their batch twins check them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import VIEWS, Tables, query, r6, sql_bucket, sql_stamp, stamp
from catalogue.drift import SLIDE, WINDOW, WINDOW_COLUMNS, WINDOW_SQL, present_windows, window_sides
from modelkeel.operators import drift as d
from modelkeel.operators.rates import FALLBACK_CRITICAL
from modelkeel.session import fresh_path
from modelkeel.sources.records import read_log, record_schema
from modelkeel.sources.sinks import fan_out, json_sink, parquet_sink
from modelkeel.streaming import common, log, state, windows


#: What one micro-batch of a registered stream reads at most.
BATCH_BYTES = 1 << 30
#: Rows that a slice of the events has at most, or about that many: a key's rows of a slice are sorted in one task.
SLICE_ROWS = 2_000_000


def call_stream(t: Tables) -> DataFrame:
    """The call view over a stream of the event files."""
    events = common.file_stream(t.spark, t.path("events"), t.events.schema, max_bytes=BATCH_BYTES)
    return events.selectExpr(*VIEWS["calls"][1])


def call_slices(t: Tables, slices: int = 4, files: int = 4, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The call view over the events as they come in: landed slice by slice of time, one slice a micro-batch.

    There are more slices when the table is larger, so that a micro-batch and what a key holds do not grow with it. The
    events are cut once, at quantiles of their time, and each slice reads its own folder only.
    """
    path, cut = fresh_path(t.spark, "event-slices"), fresh_path(t.spark, "event-cuts")
    rows = t.events.agg(F.count("ts")).first()[0]
    slices = max(slices, -(-rows // slice_rows))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = t.events.agg(F.percentile_approx(micros, [i / slices for i in range(slices)], 100 * slices)).first()[0]
    cuts = sorted(set(cuts[1:]) - {cuts[0]})
    # the slice of a row is the number of cuts up to its time
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= micros))
    placed = t.events.where("ts IS NOT NULL").withColumn("_slice", number).repartition(min(len(cuts) + 1, 1000) * files, "_slice", F.pmod("event_id", F.lit(files)))
    placed.write.partitionBy("_slice").parquet(cut)
    for i in range(len(cuts) + 1):
        part = t.spark.read.schema(t.events.schema).parquet(f"{cut}/_slice={i}")
        part.repartition(files).write.mode("append").parquet(path)
    events = common.file_stream(t.spark, path, t.events.schema, max_files=files)
    return common.with_event_time(events.selectExpr(*VIEWS["calls"][1]))


@query("stream_log_append", """
    SELECT use_case, model, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, round(sum(value), 4) AS total
    FROM {calls} GROUP BY 1, 2, 3""")
def stream_log_append(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "stream-log")
    records = call_stream(t).select(
        F.col("ts").cast("timestamp").alias("ts"), "use_case", "model", "model_version", "value", "prediction", "source"
    )
    common.drain(log.log_writer(records, path), f"{path}-checkpoint")
    return read_log(t.spark, path, record_schema({"value": "double"})).groupBy("use_case", "model", "date").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("stream_emit_fanout", """
    SELECT sink, model, count(*) AS n FROM {calls} CROSS JOIN (VALUES ('lines'), ('table')) AS s(sink) GROUP BY 1, 2""")
def stream_emit_fanout(t: Tables) -> DataFrame:
    """Every micro-batch to two sinks."""
    root = fresh_path(t.spark, "stream-fanout")
    sinks = {"lines": json_sink(f"{root}/lines"), "table": parquet_sink(f"{root}/table")}
    common.drain_batches(call_stream(t).select("event_id", "model"), fan_out(sinks, f"{root}/outcome"), "stream-fanout")
    lines = t.spark.read.schema("event_id bigint, model string").json(f"{root}/lines").select(F.lit("lines").alias("sink"), "model")
    table = t.spark.read.parquet(f"{root}/table").select(F.lit("table").alias("sink"), "model")
    return lines.unionByName(table).groupBy("sink", "model").agg(F.count(F.lit(1)).alias("n"))


# a window is closed once the watermark (newest event less ten minutes, in milliseconds) passes its end
_WATERMARK = "(SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events)"
_GRID = f"""g AS (SELECT epoch_us({sql_bucket("ts", 3600)}) // 1000000 AS t, use_case, count(*) AS calls, avg((source = 'fallback')::INT) AS ratio
             FROM {{calls}} GROUP BY 1, 2 HAVING (t + 3600) * 1000 <= {_WATERMARK})"""


def _ratios(t: Tables) -> DataFrame:
    calls = common.with_event_time(call_stream(t))
    return windows.ratio_stream(calls, F.col("source") == "fallback", ["use_case"], "1 hour")


@query("stream_fallback_ratio", f"""
    WITH {_GRID} SELECT {sql_stamp("make_timestamp(t * 1000000)")} AS window_start, use_case, calls, round(ratio, 6) AS ratio FROM g""")
def stream_fallback_ratio(t: Tables) -> DataFrame:
    """Closed hourly windows in append mode."""
    ratios = common.drain_to_table(_ratios(t), "stream-ratio")
    return ratios.select(stamp("window_start").alias("window_start"), "use_case", "calls", r6("ratio").alias("ratio"))


@query("stream_drift_windows", f"""
    SELECT * FROM ({WINDOW_SQL}) WHERE epoch_us(CAST(window_end AS TIMESTAMP)) // 1000 <= {_WATERMARK}""")
def stream_drift_windows(t: Tables) -> DataFrame:
    """Sliding windows over the stream of live calls against the frozen reference."""
    reference, _ = window_sides(t)
    edges, shares = d.reference_bins(reference, WINDOW_COLUMNS, ["model"])
    numeric = d.numeric_columns(reference, WINDOW_COLUMNS)
    live = common.with_event_time(call_stream(t).filter("ts >= TIMESTAMP_NTZ '2024-01-11'"))
    panes = windows.pane_stream(live, edges, WINDOW_COLUMNS, ["model"], numeric, SLIDE, ["model_version"])
    counts = windows.window_stream(panes, ["model", "model_version"], WINDOW, SLIDE)
    path = fresh_path(t.spark, "stream-drift")
    process = windows.psi_batches(edges, shares, ["model", "model_version"], ["model"], path)
    common.drain_batches(counts, process, "stream-drift")
    return present_windows(t.spark.read.parquet(path))


@query("stream_alert_hold", f"""
    WITH {_GRID},
    n AS (SELECT *, t - 3600 * row_number() OVER (PARTITION BY use_case ORDER BY t) AS span FROM g WHERE ratio > 0.2),
    spans AS (SELECT use_case, min(t) AS s, max(t) AS e FROM n GROUP BY use_case, span HAVING max(t) - min(t) >= 7200)
    SELECT use_case AS "key", 'firing' AS event, s AS since_s, s + 7200 AS at_s FROM spans
    UNION ALL SELECT spans.use_case, 'resolved', s, min(t) FROM spans JOIN g ON g.use_case = spans.use_case AND g.t > e GROUP BY 1, 2, 3""")
def stream_alert_hold(t: Tables) -> DataFrame:
    """Recorded ratios as one stream, the alert on their table as a second."""
    path = fresh_path(t.spark, "stream-ratio")
    ratios = common.drain_to_table(_ratios(t), "stream-ratio", path)
    grid = common.file_stream(t.spark, path, ratios.schema, max_bytes=BATCH_BYTES).select(
        F.col("use_case").alias("key"), F.col("window_start").alias("ts"), F.unix_timestamp("window_start").alias("t"),
        (F.col("ratio") > FALLBACK_CRITICAL).alias("active"),
    )
    return common.drain_to_table(state.hold_stream(common.with_event_time(grid, lateness="0 seconds"), 3600, 7200), "stream-hold")


_MARKED = "epoch_us(ts) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events)"


@query("stream_breaker_timeline", f"""
    WITH RECURSIVE c AS MATERIALIZED (SELECT pod || '/' || model AS k, epoch_us(ts) AS t, outcome <> 'ok' AS failed,
        row_number() OVER (PARTITION BY pod, model ORDER BY ts, event_id) AS i FROM {{calls}} WHERE {_MARKED}),
    s AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS failures, CAST(-1 AS BIGINT) AS opened, CAST(0 AS BIGINT) AS t,
          false AS half, '' AS after FROM c
        UNION ALL
        SELECT k, i, CASE WHEN half OR opened < 0 THEN CASE WHEN failed THEN failures + 1 ELSE 0 END ELSE failures END,
               CASE WHEN half OR opened < 0 THEN CASE WHEN failed AND failures + 1 >= 5 THEN t WHEN failed THEN opened ELSE -1 END ELSE opened END, t, half,
               CASE WHEN (half OR opened < 0) AND failed AND failures + 1 >= 5 THEN 'open' WHEN half AND NOT failed THEN 'closed' ELSE '' END
        FROM (SELECT s.k, c.i, s.failures, s.opened, c.t, c.failed, s.opened >= 0 AND c.t - s.opened >= 30000000 AS half
              FROM s JOIN c ON c.k = s.k AND c.i = s.i + 1))
    SELECT k AS "key", t, 'open' AS "before", 'half-open' AS "after" FROM s WHERE half
    UNION ALL SELECT k, t, CASE WHEN half THEN 'half-open' ELSE 'closed' END, "after" FROM s WHERE "after" <> ''""")
def stream_breaker_timeline(t: Tables) -> DataFrame:
    """Breaker transitions per pod and model, over several micro-batches."""
    calls = call_slices(t).select(
        F.concat_ws("/", "pod", "model").alias("key"), "ts", F.unix_micros("ts").alias("t"),
        F.col("event_id").alias("id"), (F.col("outcome") != "ok").alias("failed"),
    )
    return common.drain_to_table(state.breaker_stream(calls), "stream-breaker")


@query("stream_counter_increase", f"""
    WITH c AS (SELECT use_case || '/' || model AS "key", epoch_us(ts) // 3600000000 * 3600000 AS pane_ms, value,
        lag(value) OVER (PARTITION BY use_case, model ORDER BY ts, id) AS p FROM {{counters}})
    SELECT "key", pane_ms, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END) AS BIGINT) AS increase
    FROM c GROUP BY 1, 2 HAVING pane_ms + 3600000 <= {_WATERMARK}""")
def stream_counter_increase(t: Tables) -> DataFrame:
    """Hourly growth of counters that restart, each value compared with the last one of an earlier micro-batch."""
    samples = call_slices(t).select(F.concat_ws("/", "use_case", "model").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 173).alias("value"))
    return common.drain_to_table(state.counter_increase_stream(samples, 3600), "stream-increase")


_FLUSH_RECORDS, _FLUSH_AGE = 45, 21600


@query("stream_flush_batches", f"""
    WITH RECURSIVE c AS MATERIALIZED (SELECT model AS k, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS i
        FROM {{calls}} WHERE {_MARKED}),
    s AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS first_ms, CAST(0 AS BIGINT) AS size,
          CAST(-1 AS BIGINT) AS w_batch, CAST(0 AS BIGINT) AS w_first, CAST(0 AS BIGINT) AS w_size, '' AS cause FROM c
        UNION ALL
        SELECT k, i, n_batch + (n_size >= {_FLUSH_RECORDS})::BIGINT, n_first, CASE WHEN n_size >= {_FLUSH_RECORDS} THEN 0 ELSE n_size END,
               CASE WHEN aged THEN batch WHEN n_size >= {_FLUSH_RECORDS} THEN n_batch ELSE -1 END, CASE WHEN aged THEN first_ms ELSE n_first END,
               CASE WHEN aged THEN size ELSE n_size END, CASE WHEN aged THEN 'age' ELSE 'count' END
        FROM (SELECT *, batch + aged::BIGINT AS n_batch, CASE WHEN aged OR size = 0 THEN ms ELSE first_ms END AS n_first,
                     CASE WHEN aged THEN 1 ELSE size + 1 END AS n_size
              FROM (SELECT s.k, c.i, s.batch, s.first_ms, s.size, c.ms, s.size > 0 AND c.ms >= s.first_ms + {_FLUSH_AGE * 1000} AS aged
                    FROM s JOIN c ON c.k = s.k AND c.i = s.i + 1))),
    l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)
    SELECT k AS "key", w_batch AS batch, w_size AS size, w_first AS first_ms, cause FROM s WHERE w_batch >= 0
    UNION ALL SELECT k, batch, size, first_ms, 'age' FROM l WHERE size > 0 AND first_ms + {_FLUSH_AGE * 1000} <= {_WATERMARK}""")
def stream_flush_batches(t: Tables) -> DataFrame:
    """The buffers of prediction records that are written, full or due, with number, size and cause."""
    record = F.to_json(F.struct("event_id", "model", "prediction", "value"))
    records = call_slices(t).select(F.col("model").alias("key"), "ts", F.col("event_id").alias("id"), record.alias("record"))
    written = common.drain_to_table(state.flush_stream(records, _FLUSH_RECORDS, _FLUSH_AGE), "stream-flush")
    return written.where(F.size("records") == F.col("size")).drop("records")


@query("stream_monitor_staleness", f"""
    WITH s AS (SELECT use_case || '/' || model || '/' || prediction AS "key", epoch_us(ts) // 1000 AS ms FROM {{calls}}),
    l AS (SELECT "key", ms, lead(ms) OVER (PARTITION BY "key" ORDER BY ms) AS following FROM s),
    w AS (SELECT max(epoch_us(ts)) // 1000 - 600000 AS mark FROM {{calls}})
    SELECT "key", ms AS last_ms FROM l, w
    WHERE following - ms > 21600000 OR (following IS NULL AND ms + 21600000 + 1 <= mark)""")
def stream_monitor_staleness(t: Tables) -> DataFrame:
    """Stretches of more than six hours without a sample of a kind per model."""
    samples = call_slices(t)
    keyed = samples.select(F.concat_ws("/", "use_case", "model", "prediction").alias("key"), "ts", F.unix_millis("ts").alias("ms"))
    return common.drain_to_table(state.silence_stream(keyed, 21600), "stream-silence")
