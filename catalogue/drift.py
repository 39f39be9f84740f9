"""PSI per column, per model and per sliding window."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import Tables, query, r6, sql_stamp, stamp
from catalogue.joins import champions
from modelkeel.operators import drift as d
from modelkeel.plans.panestore import PaneStore
from modelkeel.session import fresh_path


def _bin_sql(n_for_k: str) -> str:
    return f"""CASE WHEN NOT isnum THEN coalesce(txt, '<null>')
        WHEN num IS NULL THEN NULL
        WHEN d <= 20 OR hi <= lo THEN CAST(num AS VARCHAR)
        ELSE CAST(CAST(greatest(least(floor((num - lo) / ((hi - lo) / ceil(log2({n_for_k}) + 1))), ceil(log2({n_for_k}) + 1) - 1), 0) AS BIGINT) AS VARCHAR) END"""


def _long_sql(source: str, keys: str, numeric: tuple[str, ...], categorical: tuple[str, ...]) -> str:
    parts = [f"SELECT {keys}is_ref, '{c}' AS col, CAST({c} AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS txt, true AS isnum FROM {source}" for c in numeric]
    parts += [f"SELECT {keys}is_ref, '{c}', CAST(NULL AS DOUBLE), CAST({c} AS VARCHAR), false FROM {source}" for c in categorical]
    return " UNION ALL ".join(parts)


def psi_ctes(sides: str, by: tuple[str, ...], numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = ()) -> str:
    """Common table expressions ending in ``psi(by…, col, bins, n_ref, n_live, psi)``."""
    keys = "".join(f"{b}, " for b in by)
    using = ", ".join([*by, "col"])
    if not numeric:
        first = categorical[0]
        long = (f"SELECT {keys}is_ref, '{first}' AS col, CAST(NULL AS DOUBLE) AS num, CAST({first} AS VARCHAR) AS txt, false AS isnum FROM sides"
                + "".join(f" UNION ALL SELECT {keys}is_ref, '{c}', NULL, CAST({c} AS VARCHAR), false FROM sides" for c in categorical[1:]))
    else:
        long = _long_sql("sides", keys, numeric, categorical)
    return f"""sides AS ({sides}),
    long AS ({long}),
    prof AS (SELECT {keys}col, sum(is_ref::INT) AS n_ref, sum((NOT is_ref)::INT) AS n_live, min(num) AS lo, max(num) AS hi,
                    count(DISTINCT CASE WHEN is_ref THEN num END) AS d, count(*) AS n FROM long GROUP BY {using}),
    bins AS (SELECT {keys}col, {_bin_sql('n')} AS bin, sum(is_ref::INT) AS c_ref, sum((NOT is_ref)::INT) AS c_live,
                    any_value(n_ref) AS n_ref, any_value(n_live) AS n_live
             FROM long JOIN prof USING ({using}) GROUP BY {using}, bin),
    shares AS (SELECT *, greatest(c_ref / n_ref, 1e-4) AS p, greatest(c_live / n_live, 1e-4) AS q FROM bins WHERE n_ref > 0 AND n_live > 0),
    psi AS (SELECT {keys}col, count(bin) AS bins, max(n_ref) AS n_ref, max(n_live) AS n_live,
                   coalesce(sum(CASE WHEN bin IS NOT NULL THEN (p - q) * ln(p / q) END), 0) AS psi FROM shares GROUP BY {using})"""


_ORDERS = "SELECT o_orderdate < TIMESTAMP '1998-01-01' AS is_ref, o_totalprice, o_orderpriority FROM orders"


def _order_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    bound = F.lit("1998-01-01").cast("timestamp_ntz")
    return t.orders.filter(F.col("o_orderdate") < bound), t.orders.filter(F.col("o_orderdate") >= bound)


@query("psi_numeric", f"WITH {psi_ctes(_ORDERS, (), ('o_totalprice',))} SELECT bins, round(psi, 6) AS psi FROM psi")
def psi_numeric(t: Tables) -> DataFrame:
    return d.psi_by_column(*_order_sides(t), ["o_totalprice"]).select("bins", r6("psi").alias("psi"))


@query("psi_categorical", f"WITH {psi_ctes(_ORDERS, (), (), ('o_orderpriority',))} SELECT bins, round(psi, 6) AS psi FROM psi")
def psi_categorical(t: Tables) -> DataFrame:
    return d.psi_by_column(*_order_sides(t), ["o_orderpriority"]).select("bins", r6("psi").alias("psi"))


# --- the monitor: reference, live window, champion rows, PSI, level ------------------------

_REF_END = "2024-01-11"
_LIVE_MINUTES = 18 * 24 * 60
_NUMERIC, _CATEGORICAL = ("value", "user_id", "k", "paid"), ("prediction",)
_COLUMNS = [*_NUMERIC, *_CATEGORICAL]

_SIDES = f"""
    SELECT use_case, model, value, user_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, paid, prediction, ts < TIMESTAMP '{_REF_END}' AS is_ref
    FROM {{calls}} c
    WHERE ts < TIMESTAMP '{_REF_END}'
       OR (ts >= (SELECT max(ts) FROM events) - INTERVAL {_LIVE_MINUTES} MINUTE
           AND model_version = (SELECT max(k.model_version) FROM {{calls}} k WHERE k.use_case = c.use_case AND k.model = c.model))"""


def monitored(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Reference rows, and the champion's rows of the live window; ``now`` is the newest event."""
    calls = t.calls.withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    now = t.events.agg(F.max("ts")).first()[0]
    reference = calls.filter(F.col("ts") < F.lit(_REF_END).cast("timestamp_ntz"))
    live = d.champion_rows(d.recent(calls, F.lit(now).cast("timestamp_ntz"), _LIVE_MINUTES), champions(t))
    return reference, live


@query("drift_report", f"""
    WITH {psi_ctes(_SIDES, (), _NUMERIC, _CATEGORICAL)}
    SELECT col AS "column", bins, n_ref, n_live, round(psi, 6) AS psi FROM psi""")
def drift_report(t: Tables) -> DataFrame:
    """All drift columns and the prediction over the whole log, one report."""
    reference, live = monitored(t)
    report = d.psi_by_column(reference, live, _COLUMNS)
    return report.select("column", "bins", "n_ref", "n_live", r6("psi").alias("psi"))


@query("drift_all_models", f"""
    WITH {psi_ctes(_SIDES, ('use_case', 'model'), _NUMERIC, _CATEGORICAL)}
    SELECT use_case, model, col AS "column", bins, n_ref, n_live, round(psi, 6) AS psi FROM psi""")
def drift_all_models(t: Tables) -> DataFrame:
    reference, live = monitored(t)
    report = d.psi_by_column(reference, live, _COLUMNS, ["use_case", "model"])
    return report.select("use_case", "model", "column", "bins", "n_ref", "n_live", r6("psi").alias("psi"))


@query("drift_level", f"""
    WITH {psi_ctes(_SIDES, ('use_case', 'model'), _NUMERIC, _CATEGORICAL)}
    SELECT use_case, model, round(max(psi), 4) AS max_psi, max(n_live) AS n_live,
           CASE WHEN max(psi) > 0.3 THEN 'retrain' WHEN max(psi) > 0.2 THEN 'warn' ELSE 'ok' END AS level FROM psi GROUP BY 1, 2""")
def drift_level(t: Tables) -> DataFrame:
    reference, live = monitored(t)
    levels = d.drift_levels(d.psi_by_column(reference, live, _COLUMNS, ["use_case", "model"]), ["use_case", "model"])
    return levels.select("use_case", "model", F.round("max_psi", 4).alias("max_psi"), "n_live", "level")


@query("psi_max", f"""
    WITH {psi_ctes(_SIDES, ('use_case', 'model'), ('value',), ('prediction',))}
    SELECT use_case, model, round(max(psi), 6) AS psi_max FROM psi GROUP BY 1, 2""")
def psi_max(t: Tables) -> DataFrame:
    """The recorded maximum per use case and model over the drift gauges."""
    reference, live = monitored(t)
    gauges = d.psi_by_column(reference, live, ["value", "prediction"], ["use_case", "model"])
    return gauges.groupBy("use_case", "model").agg(r6(F.max("psi")).alias("psi_max"))


@query("drift_skip_reasons", """
    WITH models AS (SELECT DISTINCT use_case, model FROM {runs}),
    champs AS (SELECT use_case, model, max(model_version) AS version FROM {calls} GROUP BY 1, 2),
    refs AS (SELECT DISTINCT use_case, model FROM {calls}),
    live AS (SELECT c.use_case, c.model, count(*) AS n FROM {calls} c JOIN champs k ON k.use_case = c.use_case AND k.model = c.model AND k.version = c.model_version
             WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5000 MINUTE GROUP BY 1, 2)
    SELECT m.use_case, m.model, coalesce(n, 0) AS rows,
           CASE WHEN k.use_case IS NULL THEN 'no champion yet' WHEN r.use_case IS NULL THEN 'champion has no reference'
                WHEN coalesce(n, 0) < 200 THEN coalesce(n, 0) || ' rows < 200 or no comparable columns' ELSE '' END AS skipped
    FROM models m LEFT JOIN champs k ON k.use_case = m.use_case AND k.model = m.model
    LEFT JOIN refs r ON r.use_case = m.use_case AND r.model = m.model LEFT JOIN live l ON l.use_case = m.use_case AND l.model = m.model""")
def drift_skip_reasons(t: Tables) -> DataFrame:
    """Every model with runs: judged, or the reason why not."""
    keys = ["use_case", "model"]
    now = F.lit(t.events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    live = d.champion_rows(d.recent(t.calls, now, 5000), champions(t)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    references = t.calls.select(*keys).distinct()
    reasons = d.skip_reasons(t.runs.select(*keys).distinct(), champions(t), references, live, comparable=2)
    return reasons.select(*keys, "rows", F.coalesce("skipped", F.lit("")).alias("skipped"))


WINDOW, SLIDE = "3 days", "1 day"
WINDOW_COLUMNS = ["value", "prediction"]

WINDOW_SQL = f"""
    WITH ref AS (SELECT model, value, prediction FROM {{calls}} WHERE ts < TIMESTAMP '{_REF_END}'),
    live AS (SELECT model, model_version, value, prediction, date_trunc('day', ts) AS pane FROM {{calls}} WHERE ts >= TIMESTAMP '{_REF_END}'),
    edges AS (SELECT model, min(value) AS lo, max(value) AS hi, count(*) AS n_ref, ceil(log2(count(*)) + 1) AS k FROM ref GROUP BY 1),
    refbin AS (SELECT model, 'prediction' AS col, prediction AS bin, count(*) AS c_ref FROM ref GROUP BY 1, 3
        UNION ALL SELECT model, 'value', CAST(CAST(greatest(least(floor((value - lo) / ((hi - lo) / k)), k - 1), 0) AS BIGINT) AS VARCHAR) AS bin, count(*)
        FROM ref JOIN edges USING (model) GROUP BY 1, 3),
    livebin AS (SELECT pane, model, model_version, 'prediction' AS col, prediction AS bin FROM live
        UNION ALL SELECT pane, model, model_version, 'value', CAST(CAST(greatest(least(floor((value - lo) / ((hi - lo) / k)), k - 1), 0) AS BIGINT) AS VARCHAR)
        FROM live JOIN edges USING (model)),
    spread AS (SELECT pane - INTERVAL 1 DAY * o AS ws, model, model_version, col, bin FROM livebin, (VALUES (0), (1), (2)) AS offs(o)),
    counts AS (SELECT ws, model, model_version, col, bin, count(*) AS c_live FROM spread GROUP BY 1, 2, 3, 4, 5),
    groups AS (SELECT ws, model, model_version, col, sum(c_live) AS n_live FROM counts GROUP BY 1, 2, 3, 4),
    allbins AS (SELECT g.ws, g.model, g.model_version, g.col, r.bin FROM groups g JOIN refbin r ON r.model = g.model AND r.col = g.col
                UNION SELECT ws, model, model_version, col, bin FROM counts),
    terms AS (SELECT a.*, n_live, greatest(coalesce(c_ref, 0) / n_ref, 1e-4) AS p, greatest(coalesce(c_live, 0) / n_live, 1e-4) AS q
              FROM allbins a JOIN groups g ON g.ws = a.ws AND g.model = a.model AND g.model_version = a.model_version AND g.col = a.col
              JOIN edges e ON e.model = a.model
              LEFT JOIN refbin r ON r.model = a.model AND r.col = a.col AND r.bin = a.bin
              LEFT JOIN counts c ON c.ws = a.ws AND c.model = a.model AND c.model_version = a.model_version AND c.col = a.col AND c.bin = a.bin)
    SELECT {sql_stamp('ws')} AS window_start, {sql_stamp("ws + INTERVAL 3 DAY")} AS window_end, model, model_version, col AS "column",
           CAST(max(n_live) AS BIGINT) AS n_live,
           CASE WHEN max(n_live) >= 200 THEN round(sum((p - q) * ln(p / q)), 6) ELSE -1 END AS psi,
           CASE WHEN max(n_live) < 200 THEN CAST(max(n_live) AS BIGINT) || ' rows < 200' ELSE '' END AS skipped
    FROM terms GROUP BY ws, model, model_version, col"""


def present_windows(psi: DataFrame) -> DataFrame:
    return psi.select(
        stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"), "model", "model_version",
        "column", "n_live", F.coalesce(r6("psi"), F.lit(-1.0)).alias("psi"), F.coalesce("skipped", F.lit("")).alias("skipped"),
    )


def window_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    bound = F.lit(_REF_END).cast("timestamp_ntz")
    return t.calls.filter(F.col("ts") < bound), t.calls.filter(F.col("ts") >= bound)


@query("drift_windows", WINDOW_SQL)
def drift_windows(t: Tables) -> DataFrame:
    """Overlapping three-day windows every day against the bins frozen with the reference."""
    reference, live = window_sides(t)
    edges, shares = d.reference_bins(reference, WINDOW_COLUMNS, ["model"])
    numeric = d.numeric_columns(reference, WINDOW_COLUMNS)
    # a pane is counted per model and version; the bins belong to the model
    binned = d.live_panes(live, edges, WINDOW_COLUMNS, ["model"], numeric, SLIDE, extra=["model_version"])
    psi = d.window_psi(binned, edges, shares, ["model", "model_version"], ["model"], window=WINDOW, slide=SLIDE)
    return present_windows(psi)


_STORED = f"""SELECT model, model_version, "column", n_live, psi, skipped FROM ({WINDOW_SQL})
    WHERE window_start = (SELECT strftime(date_trunc('day', max(ts)) - INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') FROM events)"""


def _stored(t: Tables) -> tuple[PaneStore, datetime]:
    """A store that has absorbed the live calls in three landings, one run of the monitor after each; and the last day."""
    reference, live = window_sides(t)
    log = fresh_path(t.spark, "live-log")
    store = PaneStore(t.spark, fresh_path(t.spark, "panes"), WINDOW_COLUMNS, ["model"], pane=SLIDE)
    store.freeze(reference)
    rows = live.select("ts", "user_id", "model", "model_version", *WINDOW_COLUMNS)
    for part in range(3):
        rows.where(F.col("user_id") % 3 == part).write.mode("append").parquet(log)
        store.absorb(log, rows.schema)
    return store, t.events.agg(F.date_trunc("day", F.max("ts").cast("timestamp"))).first()[0]


@query("monitor_window", _STORED)
def monitor_window(t: Tables) -> DataFrame:
    """The last three days of all models and versions, from pane counts that three runs of the monitor have added up."""
    store, last = _stored(t)
    report = store.report(last - timedelta(days=2), last + timedelta(days=1))
    return report.select("model", "model_version", "column", "n_live", F.coalesce(r6("psi"), F.lit(-1.0)).alias("psi"), F.coalesce("skipped", F.lit("")).alias("skipped"))


@query("monitor_levels", f"""
    WITH s AS ({_STORED}), w AS (SELECT model, model_version, max(nullif(psi, -1)) AS worst, max(n_live) AS n_live FROM s
        WHERE model_version = (SELECT max(model_version) FROM {{calls}}) GROUP BY 1, 2)
    SELECT model, model_version, n_live, CASE WHEN worst IS NULL THEN 'skipped' WHEN worst > 0.3 THEN 'retrain' WHEN worst > 0.2 THEN 'warn' ELSE 'ok' END AS level FROM w""")
def monitor_levels(t: Tables) -> DataFrame:
    """The level of every model, judged together on the rows its champion answered."""
    store, last = _stored(t)
    known = t.calls.groupBy("model").agg(F.max("model_version").alias("version"))
    report = store.report(last - timedelta(days=2), last + timedelta(days=1), champions=known)
    return store.levels(report).select("model", "model_version", "n_live", "level")
