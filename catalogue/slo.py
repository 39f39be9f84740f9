"""Service-level analytics over the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import Tables, query, r6, sql_bucket, sql_stamp, stamp
from modelkeel.functions.text import matches_label
from modelkeel.functions.vectors import circuit_code
from modelkeel.operators import alerts as a, histograms as h, rates as r

HOUR, SIX_HOURS = sql_stamp(sql_bucket("ts", 3600)), sql_stamp(sql_bucket("ts", 21600))


@query("fallback_ratio", f"""
    SELECT {HOUR} AS window_start, use_case, count(*) AS calls, round(avg((source = 'fallback')::INT), 6) AS ratio,
           CASE WHEN avg((source = 'fallback')::INT) > 0.2 THEN 'critical' WHEN avg((source = 'fallback')::INT) > 0.05 THEN 'warning' ELSE 'ok' END AS severity
    FROM {{calls}} GROUP BY 1, 2""")
def fallback_ratio(t: Tables) -> DataFrame:
    ratios = r.ratio_by_window(t.calls, F.col("source") == "fallback", ["use_case"], "1 hour")
    graded = r.graded(ratios, "ratio", r.FALLBACK_WARN, r.FALLBACK_CRITICAL)
    return graded.select(stamp("window_start").alias("window_start"), "use_case", "calls", r6("ratio").alias("ratio"), "severity")


@query("fallback_ratio_total", f"""
    SELECT {HOUR} AS window_start, count(*) AS calls, round(avg((source = 'fallback')::INT), 6) AS ratio FROM {{calls}}
    WHERE use_case IN ('uc0', 'uc2') GROUP BY 1""")
def fallback_ratio_total(t: Tables) -> DataFrame:
    """One ratio over the selected use cases."""
    chosen = t.calls.filter(F.col("use_case").isin("uc0", "uc2"))
    ratios = r.ratio_by_window(chosen, F.col("source") == "fallback", [], "1 hour")
    return ratios.select(stamp("window_start").alias("window_start"), "calls", r6("ratio").alias("ratio"))


@query("error_ratio", f"""
    SELECT {HOUR} AS window_start, use_case, count(*) AS calls,
           round(avg(regexp_full_match(status, '5..')::INT), 6) AS ratio, avg(regexp_full_match(status, '5..')::INT) > 0.05 AS firing
    FROM {{calls}} WHERE regexp_full_match(handler, '/v1/.*') GROUP BY 1, 2""")
def error_ratio(t: Tables) -> DataFrame:
    """Server errors among the calls of the public handlers."""
    public = t.calls.filter(matches_label(F.col("handler"), "/v1/.*"))
    ratios = r.ratio_by_window(public, matches_label(F.col("status"), "5.."), ["use_case"], "1 hour")
    return ratios.select(
        stamp("window_start").alias("window_start"), "use_case", "calls", r6("ratio").alias("ratio"),
        (F.col("ratio") > r.ERROR_LIMIT).alias("firing"),
    )


@query("request_rate", f"SELECT {HOUR} AS window_start, use_case, round(count(*) / 3600.0, 6) AS rate FROM {{calls}} GROUP BY 1, 2")
def request_rate(t: Tables) -> DataFrame:
    rates = r.rate_by_window(t.calls, ["use_case"], "1 hour", 3600)
    return rates.select(stamp("window_start").alias("window_start"), "use_case", r6("rate").alias("rate"))


@query("served_versions_rate", f"""
    SELECT {HOUR} AS window_start, model, model_version, round(count(*) / 3600.0, 6) AS rate FROM {{calls}}
    WHERE source = 'model' GROUP BY 1, 2, 3""")
def served_versions_rate(t: Tables) -> DataFrame:
    answered = t.calls.filter(F.col("source") == "model")
    rates = r.rate_by_window(answered, ["model", "model_version"], "1 hour", 3600)
    return rates.select(stamp("window_start").alias("window_start"), "model", "model_version", r6("rate").alias("rate"))


@query("served_versions_latest", """
    SELECT use_case, model, max_by(model_version, ts) AS model_version FROM {calls} WHERE source = 'model' GROUP BY 1, 2""")
def served_versions_latest(t: Tables) -> DataFrame:
    return r.latest(t.calls.filter(F.col("source") == "model"), ["use_case", "model"], "model_version", ["ts", "event_id"])


@query("log_flush_rate", f"SELECT {HOUR} AS window_start, model, round(count(*) / 3600.0, 6) AS rate FROM {{calls}} GROUP BY 1, 2")
def log_flush_rate(t: Tables) -> DataFrame:
    rates = r.rate_by_window(t.calls, ["model"], "1 hour", 3600)
    return rates.select(stamp("window_start").alias("window_start"), "model", r6("rate").alias("rate"))


@query("monitor_staleness", """
    WITH n AS (SELECT max(epoch_us(ts)) // 1000000 AS now FROM events),
    g AS (SELECT use_case, model, prediction, max(epoch_us(ts)) // 1000000 AS last FROM {calls} GROUP BY 1, 2, 3)
    SELECT use_case, model, prediction, now - last AS age_seconds, now - last > 1800 AS stale FROM g, n""")
def monitor_staleness(t: Tables) -> DataFrame:
    """Age of the last sample of every kind per model at the newest event."""
    now = t.events.agg(F.max("ts")).first()[0]
    return r.staleness(t.calls, ["use_case", "model", "prediction"], F.lit(now).cast("timestamp_ntz"))


@query("outcome_mix", """
    SELECT model, sum((outcome = 'ok')::INT) AS ok, sum((outcome = 'timeout')::INT) AS timeout, sum((outcome = 'error')::INT) AS error
    FROM {calls} GROUP BY 1""")
def outcome_mix(t: Tables) -> DataFrame:
    return r.outcome_mix(t.calls, "model", "outcome", ["ok", "timeout", "error"])


@query("fallback_reasons", """
    SELECT use_case, model, reason, count(*) AS n, round(count(*) / any_value(total), 6) AS share FROM (
        SELECT *, CASE WHEN outcome = 'error' AND value > 150 THEN 'slow_error' ELSE outcome END AS reason, count(*) OVER (PARTITION BY use_case, model) AS total FROM {calls})
    WHERE source = 'fallback' OR outcome = 'timeout' GROUP BY 1, 2, 3""")
def fallback_reasons(t: Tables) -> DataFrame:
    """Reasons of the answers that did not come from the model in time."""
    reasoned = t.calls.withColumn("reason", F.when((F.col("outcome") == "error") & (F.col("value") > 150), "slow_error").otherwise(F.col("outcome")))
    fallback = (F.col("source") == "fallback") | (F.col("outcome") == "timeout")
    return r.fallback_reasons(reasoned, ["use_case", "model"], "reason", fallback).withColumn("share", r6("share"))


def _gauges(t: Tables) -> DataFrame:
    return t.calls.select(
        "ts", "event_id", F.concat(F.lit("gauge_"), "prediction").alias("name"),
        F.create_map(F.lit("use_case"), "use_case", F.lit("model"), "model").alias("labels"), "value",
    )


@query("gauge_latest", """
    SELECT 'gauge_' || prediction AS name, use_case, model, max_by(value, ts) AS value FROM {calls} GROUP BY 1, 2, 3""")
def gauge_latest(t: Tables) -> DataFrame:
    last = r.latest_gauges(_gauges(t), ("ts", "event_id"))
    return last.select("name", F.col("labels")["use_case"].alias("use_case"), F.col("labels")["model"].alias("model"), "value")


@query("label_values", "SELECT DISTINCT use_case FROM {calls} WHERE prediction = 'click'")
def label_values(t: Tables) -> DataFrame:
    return r.label_values(_gauges(t), "gauge_click", "use_case")


_BUCKETS = ", ".join(f"({b})" for b in [*h.LATENCY_BUCKETS, "'Infinity'::DOUBLE"])


def _histogram_sql(keys: str, source: str) -> str:
    """CTEs ending in ``quant(keys, q, value)``; ``keys`` is a column list of ``source``."""
    return f"""src AS ({source}),
    buckets AS (SELECT {keys}, le, sum((latency <= le)::INT) AS n FROM src, (VALUES {_BUCKETS}) AS b(le) GROUP BY {keys}, le),
    edges AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS start, max(n) OVER (PARTITION BY {keys}) AS total
              FROM buckets WINDOW w AS (PARTITION BY {keys} ORDER BY le)),
    quant AS (SELECT {keys}, q, min_by(CASE WHEN le = 'Infinity'::DOUBLE THEN 2.0 ELSE start + (le - start) * (q * total - below) / nullif(n - below, 0) END, le) AS value
              FROM edges, (VALUES (0.5), (0.95), (0.99)) AS qs(q) WHERE total > 0 AND n >= q * total AND below < q * total GROUP BY {keys}, q)"""


@query("histogram_quantile", f"""
    WITH {_histogram_sql("use_case, model", "SELECT * FROM {calls}")}
    SELECT use_case, model, CAST(q AS DOUBLE) AS q, round(value, 6) AS value FROM quant""")
def histogram_quantile(t: Tables) -> DataFrame:
    buckets = h.bucket_counts(t.calls, F.col("latency"), ["use_case", "model"])
    return h.histogram_quantiles(buckets, ["use_case", "model"], [0.5, 0.95, 0.99]).select("use_case", "model", "q", r6("value").alias("value"))


@query("latency_percentiles", """
    SELECT use_case, CAST(q AS DOUBLE) AS q, round(CASE q WHEN 0.5 THEN p5 WHEN 0.95 THEN p95 ELSE p99 END, 6) AS value FROM (
        SELECT use_case, quantile_cont(latency, 0.5) AS p5, quantile_cont(latency, 0.95) AS p95, quantile_cont(latency, 0.99) AS p99
        FROM {calls} GROUP BY 1), (VALUES (0.5), (0.95), (0.99)) AS qs(q)""")
def latency_percentiles(t: Tables) -> DataFrame:
    return h.exact_quantiles(t.calls, "latency", ["use_case"], [0.5, 0.95, 0.99]).select("use_case", "q", r6("value").alias("value"))


@query("counter_increase", f"""
    WITH l AS (SELECT *, lag(value) OVER (PARTITION BY use_case, model ORDER BY ts, id) AS prev FROM {{counters}})
    SELECT {HOUR} AS window_start, use_case, model,
           CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) AS BIGINT) AS increase FROM l GROUP BY 1, 2, 3""")
def counter_increase(t: Tables) -> DataFrame:
    increase = r.counter_increase(t.counters, ["use_case", "model"], "1 hour")
    return increase.select(stamp("window_start").alias("window_start"), "use_case", "model", "increase")


HOLD_SQL = f"""
    WITH g AS (SELECT epoch_us({sql_bucket("ts", 3600)}) // 1000000 AS t, use_case, avg((source = 'fallback')::INT) AS ratio FROM {{calls}} GROUP BY 1, 2),
    n AS (SELECT *, t - 3600 * row_number() OVER (PARTITION BY use_case ORDER BY t) AS span FROM g WHERE ratio > 0.2)
    SELECT use_case, min(t) AS start_s, max(t) AS end_s, max(t) - min(t) >= 7200 AS firing,
           CASE WHEN max(t) - min(t) >= 7200 THEN min(t) + 7200 ELSE -1 END AS firing_from_s FROM n GROUP BY use_case, span"""


@query("failure_streaks", """
    WITH s AS (SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM {calls}),
    n AS (SELECT model, row_number() OVER (PARTITION BY model, island ORDER BY ts, event_id) AS streak FROM s WHERE outcome <> 'ok')
    SELECT model, streak, count(*) AS reached, streak >= 5 AS would_open FROM n GROUP BY 1, 2""")
def failure_streaks(t: Tables) -> DataFrame:
    """How many failure streaks reached each length; from five on the breaker would open."""
    streaks = a.failure_streaks(t.calls.select("model", "ts", "event_id", "outcome"), ["model"], F.col("outcome") != "ok", order=["ts", "event_id"])
    return a.streak_lengths(streaks, ["model"])


@query("circuit_state_code", """
    SELECT CASE outcome WHEN 'ok' THEN 0 WHEN 'timeout' THEN 1 ELSE 2 END AS code, count(*) AS n FROM {calls} GROUP BY 1""")
def circuit_state_code(t: Tables) -> DataFrame:
    state = F.when(F.col("outcome") == "ok", "closed").when(F.col("outcome") == "timeout", "half-open").otherwise("open")
    return t.calls.groupBy(circuit_code(state).alias("code")).agg(F.count(F.lit(1)).alias("n"))
