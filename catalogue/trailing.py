"""Rules over trailing ranges on an evaluation grid: ratios, counters, buckets, holds and canary verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogue.base import Tables, query, r6
from modelkeel.functions.text import matches_label
from modelkeel.operators import alerts as a, histograms as h, rates as r, trailing as tr

MINUTE, TEN_MINUTES, HALF_HOUR = 60, 600, 1800


def first_seen(step: int, ts: str = "ts") -> str:
    """SQL of the first grid time, in seconds, that is not before ``ts``."""
    micros = step * 1_000_000
    return f"((epoch_us({ts}) + {micros - 1}) // {micros}) * {step}"


def seen_by(source: str, step: int, ranges: tuple[int, ...], ts: str = "ts") -> str:
    """SQL that repeats each sample for every evaluation ``t`` that sees it, for each range ``r``."""
    values = ", ".join(f"({x})" for x in ranges)
    return f"""SELECT s.*, r, unnest(generate_series(t0, t0 + r - {step}, {step})) AS t
        FROM (SELECT *, {first_seen(step, ts)} AS t0 FROM {source}) s, (VALUES {values}) AS rs(r)"""


_RATIOS = (300, 1800)


@query("trailing_ratio", f"""
    WITH e AS ({seen_by("{calls}", MINUTE, _RATIOS)}),
    g AS (SELECT use_case, t, r, count(*) AS calls, sum((source = 'fallback')::INT) AS hits, sum((regexp_full_match(status, '5..'))::INT) AS broken
          FROM e GROUP BY 1, 2, 3)
    SELECT use_case, CAST(t AS BIGINT) AS t, CAST(r AS BIGINT) AS "range", calls, round(hits / calls, 6) AS ratio,
           CASE WHEN hits / calls > 0.2 THEN 'critical' WHEN hits / calls > 0.05 THEN 'warning' ELSE 'ok' END AS severity FROM g""")
def trailing_ratio(t: Tables) -> DataFrame:
    """Fallback ratio over the last five and thirty minutes, every minute, graded."""
    ratios = tr.trailing_ratio(t.calls, F.col("source") == "fallback", ["use_case"], MINUTE, _RATIOS)
    graded = r.graded(ratios, "ratio", r.FALLBACK_WARN, r.FALLBACK_CRITICAL)
    return graded.select("use_case", "t", "range", "calls", r6("ratio").alias("ratio"), "severity")


@query("trailing_error_ratio", f"""
    WITH e AS ({seen_by("{calls}", MINUTE, (300,))}),
    g AS (SELECT use_case, t, count(*) AS calls, sum((regexp_full_match(status, '5..'))::INT) AS hits FROM e GROUP BY 1, 2)
    SELECT use_case, CAST(t AS BIGINT) AS t, round(hits / calls, 6) AS ratio, hits / calls > 0.05 AS firing FROM g""")
def trailing_error_ratio(t: Tables) -> DataFrame:
    """Server errors over the last five minutes."""
    ratios = tr.trailing_ratio(t.calls, matches_label(F.col("status"), "5.."), ["use_case"], MINUTE, [300])
    return ratios.select("use_case", "t", r6("ratio").alias("ratio"), (F.col("ratio") > r.ERROR_LIMIT).alias("firing"))


def increase_sql(source: str, series: str, step: int, ranges: tuple[int, ...], name: str = "inc") -> str:
    """CTEs ending in ``inc``: samples, raw growth, increase and rate of every series, evaluation and range, by definition."""
    return f"""
    {name}_e AS ({seen_by(source, step, ranges)}),
    {name}_l AS (SELECT *, lag(value) OVER (PARTITION BY {series}, r, t ORDER BY ts, id) AS p FROM {name}_e),
    {name}_g AS (SELECT {series}, r, t, count(*) AS n, sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END) AS raw,
        min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l, arg_min(value, struct_pack(ts := ts, id := id)) AS fv
        FROM {name}_l GROUP BY {series}, r, t HAVING count(*) > 1),
    {name}_h AS (SELECT *, (l - f)::DOUBLE AS spent, (l - f) / (n - 1) AS mean, f - (t - r) * 1e6 AS head, t * 1e6 - l AS tail FROM {name}_g),
    {name}_b AS (SELECT *, CASE WHEN head >= mean * 1.1 THEN mean / 2 ELSE head END AS h1, CASE WHEN tail >= mean * 1.1 THEN mean / 2 ELSE tail END AS t1,
        CASE WHEN raw > 0 AND fv >= 0 THEN spent * fv / raw END AS zero FROM {name}_h),
    {name} AS (SELECT {series}, t, r, n, raw, CASE WHEN spent > 0 THEN raw * (spent + least(h1, zero) + t1) / spent END AS increase FROM {name}_b)"""


@query("trailing_increase", f"""
    WITH {increase_sql("{counters}", "use_case, model", TEN_MINUTES, (3600, 21600))}
    SELECT use_case, model, CAST(t AS BIGINT) AS t, CAST(r AS BIGINT) AS "range", n AS samples, CAST(raw AS BIGINT) AS raw, round(increase, 6) AS increase FROM inc""")
def trailing_increase(t: Tables) -> DataFrame:
    """Growth of counters that restart, over the last one and six hours, every ten minutes."""
    grown = tr.trailing_increase(t.counters, ["use_case", "model"], TEN_MINUTES, [3600, 21600])
    return grown.select("use_case", "model", "t", "range", "samples", "raw", r6("increase").alias("increase"))


@query("instant_values", f"""
    WITH e AS ({seen_by("{counters}", TEN_MINUTES, (3600,))})
    SELECT use_case, model, CAST(t AS BIGINT) AS t, arg_max(value, struct_pack(ts := ts, id := id)) AS value FROM e GROUP BY 1, 2, 3""")
def instant_values(t: Tables) -> DataFrame:
    """The value of each counter every ten minutes, as long as its last sample is no older than an hour."""
    return tr.instant(t.counters, ["use_case", "model"], TEN_MINUTES, staleness=3600)


# --- counters as they are scraped: running counts of a day, read whenever something happened ------------------------

DAY = 86400


def _scraped(counts: DataFrame, series: list[str]) -> DataFrame:
    """Readings ``series…, ts, id, value`` of counters that restart at midnight, from counts by pane ``t``."""
    day = Window.partitionBy(*series, F.floor((F.col("t") - 1) / DAY)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*series, F.timestamp_seconds("t").alias("ts"), F.col("t").alias("id"), F.sum("n").over(day).alias("value"))


def _scraped_sql(series: str, where: str) -> str:
    return f"""SELECT {series}, make_timestamp(CAST(t0 * 1000000 AS BIGINT)) AS ts, t0 AS id,
        sum(n) OVER (PARTITION BY {series}, (t0 - 1) // {DAY} ORDER BY t0) AS value
        FROM (SELECT {series}, {first_seen(TEN_MINUTES)} AS t0, count(*) AS n FROM {{calls}} WHERE {where} GROUP BY ALL)"""


_MATCHED = (7200, 21600)


@query("matched_ratio", f"""
    WITH req AS ({_scraped_sql("use_case, pod", "true")}), fall AS ({_scraped_sql("use_case, pod", "source = 'fallback' AND use_case <> 'uc2'")}),
    {increase_sql("req", "use_case, pod", HALF_HOUR, _MATCHED, "ri")}, {increase_sql("fall", "use_case, pod", HALF_HOUR, _MATCHED, "fi")},
    rs AS (SELECT t, r, use_case, sum(increase / r) AS v FROM ri WHERE increase IS NOT NULL GROUP BY 1, 2, 3),
    fs AS (SELECT t, r, use_case, sum(increase / r) AS v FROM fi WHERE increase IS NOT NULL GROUP BY 1, 2, 3)
    SELECT CAST(t AS BIGINT) AS t, CAST(r AS BIGINT) AS "range", use_case, round(fs.v / nullif(rs.v, 0), 6) AS ratio FROM fs JOIN rs USING (t, r, use_case)""")
def matched_ratio(t: Tables) -> DataFrame:
    """Rate of fallbacks over rate of requests, two counters scraped apart; one use case has no fallback counter."""
    series, count = ["use_case", "pod"], {"n": F.count(F.lit(1))}
    fallbacks = t.calls.where("source = 'fallback' AND use_case <> 'uc2'")
    above, below = (
        tr.sum_by(tr.trailing_increase(_scraped(tr.panes(df, series, TEN_MINUTES, **count), series), series, HALF_HOUR, _MATCHED), ["use_case"], "rate")
        for df in (fallbacks, t.calls))
    return tr.matched_ratio(above, below, ["use_case"], "rate").select("t", "range", "use_case", r6("ratio").alias("ratio"))


_BOUNDS = ", ".join(f"({b})" for b in [*h.LATENCY_BUCKETS, "'Infinity'::DOUBLE"])

#: CTEs ending in ``quant(use_case, t, q, value)`` from ``buckets(use_case, t, le, n)``, as rules compute it.
_QUANTILE = """
    mono AS (SELECT use_case, t, le, max(n) OVER (PARTITION BY use_case, t ORDER BY le) AS n FROM buckets),
    edges AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS start, max(n) OVER (PARTITION BY use_case, t) AS total
              FROM mono WINDOW w AS (PARTITION BY use_case, t ORDER BY le)),
    quant AS (SELECT use_case, t, q, min_by(CASE WHEN le = 'Infinity'::DOUBLE THEN 2.0 ELSE start + (le - start) * (q * total - below) / nullif(n - below, 0) END, le) AS value
              FROM edges, (VALUES (0.5), (0.99)) AS qs(q) WHERE total > 0 AND n >= q * total AND below < q * total GROUP BY 1, 2, 3)"""


@query("bucket_quantile", f"""
    WITH cells AS (SELECT use_case, pod, handler, {first_seen(TEN_MINUTES)} AS t0, le, sum((latency <= le)::INT) AS n
                   FROM {{calls}}, (VALUES {_BOUNDS}) AS b(le) WHERE regexp_full_match(handler, '/v1/.*') GROUP BY ALL),
    scrapes AS (SELECT use_case, pod, handler, le, make_timestamp(CAST(t0 * 1000000 AS BIGINT)) AS ts, t0 AS id,
        sum(n) OVER (PARTITION BY use_case, pod, handler, le, (t0 - 1) // {DAY} ORDER BY t0) AS value FROM cells),
    {increase_sql("scrapes", "use_case, pod, handler, le", HALF_HOUR, (21600,))},
    buckets AS (SELECT use_case, t, le, sum(increase / r) AS n FROM inc WHERE increase IS NOT NULL GROUP BY 1, 2, 3), {_QUANTILE}
    SELECT use_case, CAST(t AS BIGINT) AS t, CAST(q AS DOUBLE) AS q, round(value + 1e-10, 8) AS value FROM quant""")
def bucket_quantile(t: Tables) -> DataFrame:
    """Median and p99 of the public handlers over the last six hours, from scraped bucket counters that restart.

    Many values end in a five at the last digit; the small addend makes both engines round them up.
    """
    series = ["use_case", "pod", "handler"]
    public = t.calls.where(matches_label(F.col("handler"), "/v1/.*")).withColumn("t", tr.evaluation("ts", TEN_MINUTES))
    scrapes = _scraped(h.bucket_counts(public, F.col("latency"), [*series, "t"]), [*series, "le"])
    rates = tr.bucket_rates(scrapes, series, ["use_case"], HALF_HOUR, [21600])
    return h.histogram_quantiles(rates, ["use_case", "t"], [0.5, 0.99]).select("use_case", "t", "q", F.round(F.col("value") + 1e-10, 8).alias("value"))


# --- what is decided on the grid ------------------------------------------------------------------------------------


@query("alert_hold", f"""
    WITH e AS ({seen_by("{calls}", MINUTE, (300,))}),
    g AS (SELECT CAST(t AS BIGINT) AS t, use_case FROM e GROUP BY t, use_case HAVING avg((source = 'fallback')::INT) > 0.2),
    n AS (SELECT *, t - {MINUTE} * row_number() OVER (PARTITION BY use_case ORDER BY t) AS span FROM g)
    SELECT use_case, min(t) AS start_s, max(t) AS end_s, max(t) - min(t) >= 300 AS firing,
           CASE WHEN max(t) - min(t) >= 300 THEN min(t) + 300 ELSE -1 END AS firing_from_s FROM n GROUP BY use_case, span""")
def alert_hold(t: Tables) -> DataFrame:
    """Spans of critical fallback ratio over the last five minutes, every minute; firing after five minutes."""
    grid = tr.trailing_ratio(t.calls, F.col("source") == "fallback", ["use_case"], MINUTE, [300])
    spans = a.alert_holds(grid, ["use_case"], F.col("ratio") > r.FALLBACK_CRITICAL, step_seconds=MINUTE, hold_seconds=300)
    return spans.withColumn("firing_from_s", F.coalesce("firing_from_s", F.lit(-1)))


_CANARY = f"""
    WITH canary AS (SELECT * FROM {{calls}} WHERE contains(pod, '5d2b')), e AS ({seen_by("canary", 30, (120,))}),
    buckets AS (SELECT use_case, t, le, sum((latency <= le)::INT) AS n FROM e, (VALUES {_BOUNDS}) AS b(le)
                WHERE regexp_full_match(handler, '/v1/.*') GROUP BY 1, 2, 3), {_QUANTILE},
    sums AS (SELECT use_case, t, avg((regexp_full_match(status, '5..'))::INT) AS err, avg((source = 'fallback')::INT) AS fb FROM e GROUP BY 1, 2),
    checks AS (SELECT use_case, t, 'error-ratio' AS "check", err AS value, NOT (err < 0.02) AS failed FROM sums
        UNION ALL SELECT use_case, t, 'fallback-ratio', fb, NOT (fb < 0.2) FROM sums
        UNION ALL SELECT use_case, t, 'p99-latency', coalesce(value, 0), NOT (coalesce(value, 0) < 0.3)
                  FROM sums LEFT JOIN (SELECT * FROM quant WHERE q = 0.99) USING (use_case, t))"""


def _canary(t: Tables) -> DataFrame:
    """Checks of the pods of one hash over the last two minutes, every thirty seconds."""
    calls = t.calls.filter(F.contains("pod", F.lit("5d2b")))
    return a.canary_checks(calls, ["use_case"], error=matches_label(F.col("status"), "5.."), fallback=F.col("source") == "fallback",
                           latency=F.col("latency"), public=matches_label(F.col("handler"), "/v1/.*"))


@query("canary_checks", _CANARY + ' SELECT use_case, CAST(t AS BIGINT) AS t, "check", round(value, 6) AS value, failed FROM checks')
def canary_checks(t: Tables) -> DataFrame:
    return _canary(t).select("use_case", "t", "check", r6("value").alias("value"), "failed")


@query("canary_verdict", _CANARY + """,
    v AS (SELECT *, sum(failed::INT) OVER (PARTITION BY use_case, "check" ORDER BY t RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS failures FROM checks)
    SELECT use_case, CAST(t AS BIGINT) AS t, "check", CAST(failures AS BIGINT) AS failures, failures > 1 AS aborted FROM v""")
def canary_verdict(t: Tables) -> DataFrame:
    return a.canary_verdicts(_canary(t), ["use_case"]).select("use_case", "t", "check", "failures", "aborted")
