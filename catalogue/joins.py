"""Lookups that become joins once their inputs are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import Tables, query, r6
from modelkeel.operators.drift import champion_rows, drift_levels, psi_by_column
from modelkeel.operators.gate import compare_f1_macro
from modelkeel.operators.registry import champion_as_of, retrain_requests, validity, with_lineage

#: Champion versions per use case and model, derived from the call log itself.
_CHAMPIONS = "SELECT use_case, model, max(model_version) AS version FROM {calls} GROUP BY 1, 2"


def champions(t: Tables) -> DataFrame:
    """The newest version each model served."""
    return t.calls.groupBy("use_case", "model").agg(F.max("model_version").alias("version"))


@query("semi_join_champion", f"""
    WITH champions AS ({_CHAMPIONS})
    SELECT event_id, c.use_case, c.model, model_version FROM {{calls}} c
    WHERE EXISTS (SELECT 1 FROM champions k WHERE k.use_case = c.use_case AND k.model = c.model AND k.version = c.model_version)""")
def semi_join_champion(t: Tables) -> DataFrame:
    kept = champion_rows(t.calls, champions(t))
    return kept.select("event_id", "use_case", "model", "model_version")


_F1 = """
    confusion AS (SELECT role, y, p, count(*) AS n FROM (
        SELECT 'candidate' AS role, y, candidate AS p FROM {classified}
        UNION ALL SELECT 'champion', y, champion FROM {classified}) GROUP BY 1, 2, 3),
    labels_seen AS (SELECT role, y AS label FROM confusion UNION SELECT role, p FROM confusion),
    f1 AS (SELECT l.role, l.label,
        2.0 * sum(CASE WHEN y = l.label AND p = l.label THEN n ELSE 0 END)
        / (sum(CASE WHEN y = l.label THEN n ELSE 0 END) + sum(CASE WHEN p = l.label THEN n ELSE 0 END)) AS f
        FROM labels_seen l JOIN confusion c ON c.role = l.role AND (c.y = l.label OR c.p = l.label) GROUP BY 1, 2),
    macro AS (SELECT role, avg(f) AS f1 FROM f1 GROUP BY 1)"""


@query("champion_challenger", f"""
    WITH {_F1}
    SELECT round(max(CASE WHEN role = 'candidate' THEN f1 END), 6) AS candidate,
           round(max(CASE WHEN role = 'champion' THEN f1 END), 6) AS champion FROM macro""")
def champion_challenger(t: Tables) -> DataFrame:
    """Two models on the same documents, macro F1 of both from one scan."""
    both = compare_f1_macro(t.classified, "y", "candidate", "champion")
    return both.select(r6("candidate").alias("candidate"), r6("champion").alias("champion"))


@query("version_lineage", """
    SELECT o_orderkey, 'run-' || o_custkey AS run_id, coalesce(data_hash, '') AS data_hash,
           coalesce(git_commit, '') AS git_commit, '' AS reference_uri
    FROM orders LEFT JOIN (SELECT s_suppkey, md5(s_name) AS data_hash, CAST(s_nationkey AS VARCHAR) AS git_commit
                           FROM supplier) r ON o_custkey = s_suppkey""")
def version_lineage(t: Tables) -> DataFrame:
    """Versions of the orders, lineage tags of the suppliers' runs; customers beyond them have no run."""
    versions = t.orders.select("o_orderkey", F.concat(F.lit("run-"), F.col("o_custkey")).alias("run_id"))
    tags = F.create_map(F.lit("data_hash"), F.md5("s_name"), F.lit("git_commit"), F.col("s_nationkey").cast("string"))
    runs = t.supplier.select(F.concat(F.lit("run-"), F.col("s_suppkey")).alias("run_id"), tags.alias("tags"))
    return with_lineage(versions, runs)


@query("retrain_not_inflight", """
    WITH sides AS (SELECT use_case, model, CASE WHEN use_case = 'uc1' THEN prediction ELSE model_version END AS v,
                          ts < TIMESTAMP '2024-01-16' AS is_ref FROM {calls}),
    totals AS (SELECT use_case, model, sum(is_ref::INT) AS n_ref, sum((NOT is_ref)::INT) AS n_live FROM sides GROUP BY 1, 2),
    bins AS (SELECT use_case, model, v, sum(is_ref::INT) AS c_ref, sum((NOT is_ref)::INT) AS c_live FROM sides GROUP BY 1, 2, 3),
    psi AS (SELECT use_case, model,
              sum((greatest(c_ref / n_ref, 1e-4) - greatest(c_live / n_live, 1e-4))
                  * ln(greatest(c_ref / n_ref, 1e-4) / greatest(c_live / n_live, 1e-4))) AS psi
            FROM bins JOIN totals USING (use_case, model) GROUP BY 1, 2),
    ranked AS (SELECT use_case, model, phase, row_number() OVER (PARTITION BY use_case, model ORDER BY ts DESC, o_orderkey DESC) AS r FROM {runs}),
    busy AS (SELECT use_case, model FROM ranked WHERE r = 1 AND phase = 'Running')
    SELECT use_case, model, round(psi, 6) AS max_psi FROM psi
    WHERE psi > 0.3 AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.use_case = psi.use_case AND b.model = psi.model)""")
def retrain_not_inflight(t: Tables) -> DataFrame:
    """Models whose live half drifted away and whose latest run is not in flight."""
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    watched = t.calls.withColumn("v", F.when(F.col("use_case") == "uc1", F.col("prediction")).otherwise(F.col("model_version")))
    report = psi_by_column(
        watched.filter(F.col("ts") < split), watched.filter(F.col("ts") >= split), ["v"], ["use_case", "model"]
    )
    runs = t.runs.groupBy("use_case", "model").agg(F.max_by("phase", F.struct("ts", "o_orderkey")).alias("phase"))
    wanted = retrain_requests(drift_levels(report, ["use_case", "model"]), runs)
    return wanted.select("use_case", "model", r6("max_psi").alias("max_psi"))


# --- the champion at the time of a record ------------------------------------------------------------------------------

#: Promotions: the versions of a model change with every signup of one of its first users, some of them back.
_PROMOTED = """promoted AS (SELECT model AS name, 'champion' AS alias, CAST(event_id % 4 AS INT) AS version, ts, event_id AS seq
        FROM {calls} WHERE prediction = 'signup' AND user_id % 10 < 4)"""


def _promoted(t: Tables) -> DataFrame:
    chosen = t.calls.where("prediction = 'signup' AND user_id % 10 < 4")
    return chosen.selectExpr("model AS name", "'champion' AS alias", "CAST(event_id % 4 AS INT) AS version", "ts", "event_id AS seq")


@query("champion_intervals", f"""
    WITH {_PROMOTED}, l AS (SELECT *, lag(version) OVER (PARTITION BY name ORDER BY ts, seq) AS p FROM promoted),
    c AS (SELECT * FROM l WHERE p IS NULL OR p <> version)
    SELECT name, version, epoch_us(ts) AS valid_from, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY name ORDER BY ts, seq), -1) AS valid_to FROM c""")
def champion_intervals(t: Tables) -> DataFrame:
    """When each version was champion."""
    spans = validity(_promoted(t))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return spans.select("name", "version", micros("valid_from").alias("valid_from"), F.coalesce(micros("valid_to"), F.lit(-1)).alias("valid_to"))


@query("champion_as_of", f"""
    WITH {_PROMOTED}
    SELECT c.event_id, c.model, coalesce(p.version, -1) AS champion, CAST(c.event_id % 4 AS INT) = p.version AS served_by_it
    FROM {{calls}} c ASOF LEFT JOIN promoted p ON c.model = p.name AND c.ts >= p.ts""")
def champion_of_each_call(t: Tables) -> DataFrame:
    """The champion when each call was made, and whether it served it."""
    records = t.calls.selectExpr("event_id AS id", "model AS name", "ts", "CAST(event_id % 4 AS INT) AS served")
    known = champion_as_of(records, _promoted(t))
    return known.select(F.col("id").alias("event_id"), F.col("name").alias("model"), F.coalesce("champion", F.lit(-1)).alias("champion"),
                        (F.col("served") == F.col("champion")).alias("served_by_it"))


@query("drift_rows_as_of", f"""
    WITH {_PROMOTED}, known AS (SELECT c.model, c.value, CAST(c.event_id % 4 AS INT) AS served, p.version
                                FROM {{calls}} c ASOF LEFT JOIN promoted p ON c.model = p.name AND c.ts >= p.ts)
    SELECT model, version, count(*) AS n, round(sum(value), 4) AS total FROM known WHERE served = version GROUP BY 1, 2""")
def drift_rows_as_of(t: Tables) -> DataFrame:
    """Live rows that the champion of their own time answered, by version: what a judgement of each version may see."""
    records = t.calls.selectExpr("event_id AS id", "model AS name", "ts", "CAST(event_id % 4 AS INT) AS served", "value")
    kept = champion_as_of(records, _promoted(t)).where("served = champion")
    return kept.groupBy(F.col("name").alias("model"), F.col("champion").alias("version")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
