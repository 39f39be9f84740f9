"""Registry history: aliases, versions, promotions, rollbacks, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import Tables, query, sql_stamp, stamp
from modelkeel.operators import registry as reg
from modelkeel.operators.rates import count_by_window

_ORDER = ["ts", "seq"]

_EVENTS = """
    lagged AS (SELECT *, lag(version) OVER (PARTITION BY name ORDER BY ts, seq) AS old FROM {promotions}),
    alias_events AS (SELECT name, ts, seq, "trigger", 'champion' AS alias, version, 1 AS step FROM lagged
               UNION ALL SELECT name, ts, seq, "trigger", 'previous', old, 0 FROM lagged WHERE old IS NOT NULL AND old <> version),
    current_alias AS (SELECT name, alias, max_by(version, struct_pack(ts := ts, seq := seq, step := step)) AS version FROM alias_events GROUP BY 1, 2)"""


def alias_events(t: Tables) -> DataFrame:
    """Alias log of all promotions; ``step`` orders the two events of one promotion."""
    promotions = t.promotions.withColumnRenamed("seq", "order_key")
    events = reg.promotion_events(promotions, ["ts", "order_key"])
    return events.withColumnRenamed("seq", "step").withColumnRenamed("order_key", "seq")


@query("promote_events", f"""
    WITH {_EVENTS} SELECT name, alias, version, "trigger", seq, {sql_stamp('ts')} AS at FROM alias_events""")
def promote_events(t: Tables) -> DataFrame:
    return alias_events(t).select("name", "alias", "version", "trigger", "seq", stamp("ts").alias("at"))


@query("registry_current", f"WITH {_EVENTS} SELECT name, alias, version FROM current_alias")
def registry_current(t: Tables) -> DataFrame:
    return reg.current_aliases(alias_events(t), ("ts", "seq", "step"))


@query("registry_previous", f"""
    WITH {_EVENTS} SELECT name, max(CASE WHEN alias = 'champion' THEN version END) AS champion,
        coalesce(max(CASE WHEN alias = 'previous' THEN version END), -1) AS previous FROM current_alias GROUP BY 1""")
def registry_previous(t: Tables) -> DataFrame:
    """Champion and previous champion straight from the promotions, without replaying them."""
    return reg.previous_champion(t.promotions).select(
        "name", "champion", F.coalesce("previous", F.lit(-1)).alias("previous")
    )


@query("rollback_target", f"""
    WITH {_EVENTS}, pivoted AS (SELECT name, max(CASE WHEN alias = 'champion' THEN version END) AS champion,
        max(CASE WHEN alias = 'previous' THEN version END) AS version FROM current_alias GROUP BY 1)
    SELECT name, champion, coalesce(version, -1) AS version, CASE WHEN version IS NULL THEN '' ELSE 'rollback' END AS "trigger",
           CASE WHEN version IS NULL THEN 'no previous champion' ELSE '' END AS error FROM pivoted""")
def rollback_target(t: Tables) -> DataFrame:
    found = reg.rollback_targets(alias_events(t), ("ts", "seq", "step"))
    return found.select(
        "name", "champion", F.coalesce("version", F.lit(-1)).alias("version"),
        F.coalesce("trigger", F.lit("")).alias("trigger"), F.coalesce("error", F.lit("")).alias("error"),
    )


@query("register_versions", """
    WITH numbered AS (SELECT name, seq, row_number() OVER (PARTITION BY name ORDER BY ts, seq) AS n
                      FROM {promotions} WHERE "trigger" <> 'manual'),
    existing AS (SELECT name, max(version) AS top FROM {promotions} WHERE "trigger" = 'manual' GROUP BY 1)
    SELECT n.name, seq, n + coalesce(top, 0) AS version, 's3://models/' || replace(n.name, '-', '/') || '/v' || (n + coalesce(top, 0)) AS serving_uri
    FROM numbered n LEFT JOIN existing e ON e.name = n.name""")
def register_versions(t: Tables) -> DataFrame:
    """New runs numbered after the versions their model already has."""
    manual = F.col("trigger") == "manual"
    new = t.promotions.filter(~manual).select("name", "ts", "seq")
    numbered = reg.next_versions(new, _ORDER, t.promotions.filter(manual).select("name", "version"))
    uri = reg.serving_uri("s3://models", F.split_part("name", F.lit("-"), F.lit(1)), F.split_part("name", F.lit("-"), F.lit(2)), F.col("version"))
    return numbered.select("name", "seq", "version", uri.alias("serving_uri"))


@query("latest_runs", """
    SELECT run_id, use_case, phase FROM {runs} ORDER BY ts DESC, o_orderkey DESC LIMIT 10""")
def latest_runs(t: Tables) -> DataFrame:
    return reg.latest_runs(t.runs, ["ts", "o_orderkey"], 10).select("run_id", "use_case", "phase")


@query("runs_by_phase", "SELECT phase, count(*) AS n FROM {runs} GROUP BY 1")
def runs_by_phase(t: Tables) -> DataFrame:
    return t.runs.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("runs_increase", f"""
    SELECT {sql_stamp("date_trunc('day', ts)")} AS day, use_case, count(*) AS failed FROM {{runs}}
    WHERE phase = 'Failed' GROUP BY 1, 2 HAVING count(*) > 1""")
def runs_increase(t: Tables) -> DataFrame:
    """Days and use cases with more than one failed run."""
    failed = t.runs.filter(F.col("phase") == "Failed")
    counted = count_by_window(failed, ["use_case"], "1 day", F.col("n") > 1)
    return counted.select(stamp("window_start").alias("day"), "use_case", F.col("n").alias("failed"))
