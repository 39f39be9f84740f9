"""Sources and sinks: round trips over whole tables compare with the table itself."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import Tables, query, r6, sql_stamp, stamp
from modelkeel.functions.text import experiment_name, registered_name
from modelkeel.operators.drift import psi_by_column
from modelkeel.operators.rates import latest
from modelkeel.operators.split import sample_records as sampled
from modelkeel.session import fresh_path
from modelkeel.sources.datasets import (
    RESULTS, newest_file_time, oldest_file_time, read_dataset, read_rows_since, rows_by_file, scalar_entries, write_dataset,
)
from modelkeel.sources.jsonunion import read_json_union, variant_text
from modelkeel.sources.layout import uri_bucket, uri_key
from modelkeel.sources.metric_text import drift_gauges, parse_samples
from modelkeel.sources.records import append_log, log_window, read_json_lines, read_log, record_schema, with_log_partitions
from modelkeel.sources.sinks import emit, json_sink, parquet_sink
from modelkeel.sources.topic import TOPIC_ROW, decode_window, to_topic_rows

_ORDER_SUMMARY = """
    SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_key
    FROM orders GROUP BY 1"""


def _order_summary(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.max("o_orderkey").alias("last_key"),
    )


@query("scan_parquet", _ORDER_SUMMARY)
def scan_parquet(t: Tables) -> DataFrame:
    return _order_summary(read_dataset(t.spark, t.path("orders")))


@query("parquet_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def parquet_roundtrip(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "dataset")
    write_dataset(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return read_dataset(t.spark, path)


@query("uri_parts", """
    SELECT page_id, split_part(rest, '/', 1) AS bucket,
           CASE WHEN position('/' IN rest) > 0 THEN substr(rest, position('/' IN rest) + 1) ELSE '' END AS object_key
    FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages)""")
def uri_parts(t: Tables) -> DataFrame:
    """Page addresses re-schemed as object addresses, split into bucket and key."""
    uri = F.regexp_replace("url", "^[a-z]+://", "s3://")
    return t.pages.select("page_id", uri_bucket(uri).alias("bucket"), uri_key(uri).alias("object_key"))


@query("files_since", """
    SELECT event_type, CAST(count(DISTINCT user_id % 3 > 0) AS BIGINT) AS landings, count(*) AS n, round(sum(value), 4) AS total
    FROM events WHERE user_id % 3 > 0 GROUP BY 1""")
def files_since_a_landing(t: Tables) -> DataFrame:
    """Rows of the files that were landed after a bound: three landings, the bound lies at the second one's files.

    The predicate on the file time picks the files before any of them is opened.
    """
    path = fresh_path(t.spark, "landings")
    rest = t.events.select("event_id", "user_id", "event_type", "value")
    rest.where("user_id % 3 = 0").write.parquet(path)
    first = newest_file_time(t.spark.read.parquet(path))
    rest.where("user_id % 3 = 1").write.mode("append").parquet(path)
    rest.where("user_id % 3 = 2").write.mode("append").parquet(path)
    landed = t.spark.read.schema(rest.schema).parquet(path)
    recent = read_rows_since(landed, F.lit(first + timedelta(milliseconds=1)))
    return recent.groupBy("event_type").agg(
        F.count_distinct(F.col("user_id") % 3 > 0).alias("landings"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("rows_by_file", """
    SELECT part, count(*) AS n FROM (SELECT CAST(event_id % 4 AS INT) AS part FROM events) GROUP BY 1""")
def rows_of_each_file(t: Tables) -> DataFrame:
    """Rows of every landed file, with none older than a bound in the past left out (the bound is inclusive)."""
    path = fresh_path(t.spark, "parts")
    t.events.select("event_id", (F.col("event_id") % 4).cast("int").alias("part")).repartition("part").write.partitionBy("part").parquet(path)
    landed = t.spark.read.parquet(path)
    counted = rows_by_file(landed, F.lit(oldest_file_time(landed)))
    return counted.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("int").alias("part"), "n").groupBy("part").agg(F.sum("n").alias("n"))


_RECORD_FEATURES = {"value": "double", "user_id": "long"}


def _records(t: Tables) -> DataFrame:
    return t.calls.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("request_id"),
        "value", "user_id", "model", "model_version", "prediction",
        F.lit(None).cast("double").alias("score"), "source", "use_case",
    )


@query("jsonl_scan", """
    SELECT CAST(event_id AS VARCHAR) AS request_id, model, prediction, round(value, 4) AS value, """
       + sql_stamp("ts") + """ AS at FROM {calls}""")
def jsonl_scan(t: Tables) -> DataFrame:
    """Records written as JSON lines, read back under an explicit schema."""
    path = fresh_path(t.spark, "jsonl")
    _records(t).drop("use_case", "score").write.json(path)
    back = read_json_lines(t.spark, path, record_schema(_RECORD_FEATURES))
    return back.filter(F.col("score").isNull()).select(
        "request_id", "model", "prediction", F.round("value", 4).alias("value"), stamp("ts").alias("at")
    )


@query("jsonl_partitioned_write", """
    SELECT use_case, model, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, round(sum(value), 4) AS total
    FROM {calls} GROUP BY 1, 2, 3""")
def jsonl_partitioned_write(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "log")
    append_log(with_log_partitions(_records(t)), path)
    log = read_log(t.spark, path, record_schema(_RECORD_FEATURES))
    return log.groupBy("use_case", "model", "date").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("log_recent", """
    SELECT use_case, model, count(*) AS n, round(sum(value), 4) AS total FROM {calls}
    WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2""")
def log_recent(t: Tables) -> DataFrame:
    """A window of the partitioned log; the day predicate prunes folders."""
    path = fresh_path(t.spark, "log")
    append_log(with_log_partitions(_records(t)), path)
    log = read_log(t.spark, path, record_schema(_RECORD_FEATURES))
    recent = log_window(log, F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return recent.groupBy("use_case", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


def _topic(t: Tables) -> DataFrame:
    """The calls as topic rows: three partitions, offsets in event order."""
    value = F.to_json(F.struct("model", "user_id", F.round("value", 4).alias("value")))
    return t.calls.select(
        (F.col("event_id") % 3).cast("int").alias("partition"), F.floor(F.col("event_id") / 3).alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("model").alias("key"), value.alias("value"),
    ).to(TOPIC_ROW)


@query("topic_window", """
    WITH rows AS (SELECT event_id % 3 AS part, event_id // 3 AS off, ts, model, user_id, value FROM {calls}),
         marks AS (SELECT part, max(off) AS high FROM rows GROUP BY 1)
    SELECT rows.part AS "partition", off AS "offset", user_id, round(value, 4) AS value
    FROM rows JOIN marks USING (part)
    WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND off < high AND model = 'categorizer'""")
def topic_window(t: Tables) -> DataFrame:
    """Records of one model since a time, below each partition's high mark."""
    rows = _topic(t)
    marks = rows.groupBy("partition").agg(F.max("offset").alias("high_mark"))
    schema = "model string, user_id bigint, value double"
    since = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return decode_window(rows, schema, since, model="categorizer", high_marks=marks).select(
        "partition", "offset", "user_id", F.round("value", 4).alias("value")
    )


@query("topic_records", """
    SELECT 'predictions' AS topic, model AS "key",
           '{"model":"' || model || '","user_id":' || user_id || ',"prediction":"' || prediction || '"}' AS value
    FROM {calls}""")
def topic_records(t: Tables) -> DataFrame:
    return to_topic_rows(t.calls.select("model", "user_id", "prediction"))


@query("emit_fanout", """
    SELECT sink, model, count(*) AS n FROM {calls} CROSS JOIN (VALUES ('lines'), ('table')) AS s(sink)
    GROUP BY 1, 2
    UNION ALL SELECT 'failed: broken', 'error row', 1""")
def emit_fanout(t: Tables) -> DataFrame:
    """One batch to two sinks that work and one that fails; the failure is a row, not an error."""
    lines, table = fresh_path(t.spark, "lines"), fresh_path(t.spark, "table")

    def broken(batch: DataFrame, batch_id: int) -> None:
        raise OSError("sink is down")

    outcome = emit(
        t.calls.select("event_id", "model", "prediction"), 0,
        {"lines": json_sink(lines), "broken": broken, "table": parquet_sink(table)},
    )
    schema = "event_id bigint, model string, prediction string"
    written = t.spark.read.schema(schema).json(f"{lines}/batch_id=0").select(F.lit("lines").alias("sink"), "model").unionByName(
        t.spark.read.parquet(f"{table}/batch_id=0").select(F.lit("table").alias("sink"), "model")
    )
    counts = written.groupBy("sink", "model").agg(F.count(F.lit(1)).alias("n"))
    failed = outcome.filter(~F.col("ok")).groupBy("sink").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("failed: "), F.col("sink")).alias("sink"), F.lit("error row").alias("model"), "n"
    )
    return counts.unionByName(failed)


@query("step_result_scalars", """
    SELECT run_id, step, name, value FROM (
      SELECT 'run-' || o_orderkey AS run_id, 'evaluate' AS step, 'promote' AS name,
             CASE WHEN o_totalprice > 250000 THEN 'true' ELSE 'false' END AS value FROM orders
      UNION ALL SELECT 'run-' || o_orderkey, 'evaluate', 'rows', CAST(o_custkey AS VARCHAR) FROM orders
      UNION ALL SELECT 'run-' || o_orderkey, 'evaluate', 'reason', o_orderpriority FROM orders)""")
def step_result_scalars(t: Tables) -> DataFrame:
    """Result documents of the orders as steps; the nested metrics entry has no scalar."""
    document = F.to_json(F.struct(
        (F.col("o_totalprice") > 250000).alias("promote"), F.col("o_custkey").alias("rows"),
        F.col("o_orderpriority").alias("reason"),
        F.struct(F.col("o_totalprice").alias("mae")).alias("metrics"), F.array("o_orderstatus").alias("columns"),
    ))
    results = t.orders.select(
        F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), F.lit("evaluate").alias("step"),
        document.alias("result_json"),
    ).to(RESULTS)
    return scalar_entries(results)


@query("drift_metric_rows", """
    WITH sides AS (SELECT use_case, model, prediction, ts < TIMESTAMP '2024-01-11' AS is_ref FROM {calls}),
    totals AS (SELECT use_case, model, sum(is_ref::INT) AS n_ref, sum((NOT is_ref)::INT) AS n_live FROM sides GROUP BY 1, 2),
    bins AS (SELECT use_case, model, prediction, sum(is_ref::INT) AS c_ref, sum((NOT is_ref)::INT) AS c_live
             FROM sides GROUP BY 1, 2, 3),
    psi AS (SELECT use_case, model, max(n_live) AS n_live,
              sum((greatest(c_ref / n_ref, 1e-4) - greatest(c_live / n_live, 1e-4))
                  * ln(greatest(c_ref / n_ref, 1e-4) / greatest(c_live / n_live, 1e-4))) AS psi
            FROM bins JOIN totals USING (use_case, model) GROUP BY 1, 2),
    last AS (SELECT epoch_us(max(ts)) // 1000000 AS last_run FROM events)
    SELECT use_case, model, 'ct_drift_psi' AS name, 'prediction' AS "column", round(psi, 6) AS value FROM psi
    UNION ALL SELECT use_case, model, 'ct_drift_detected', '', CASE WHEN psi > 0.3 THEN 1.0 ELSE 0.0 END FROM psi
    UNION ALL SELECT use_case, model, 'ct_drift_window_rows', '', CAST(n_live AS DOUBLE) FROM psi
    UNION ALL SELECT use_case, model, 'ct_drift_last_run_timestamp_seconds', '', CAST(last_run AS DOUBLE) FROM psi, last
    UNION ALL SELECT use_case, model, 'ct_drift_threshold_warn', '', 0.2 FROM psi
    UNION ALL SELECT use_case, model, 'ct_drift_threshold_retrain', '', 0.3 FROM psi""")
def drift_metric_rows(t: Tables) -> DataFrame:
    split = F.lit("2024-01-11").cast("timestamp_ntz")
    now = t.events.agg(F.max("ts")).first()[0]
    report = psi_by_column(
        t.calls.filter(F.col("ts") < split), t.calls.filter(F.col("ts") >= split), ["prediction"], ["use_case", "model"]
    )
    gauges = drift_gauges(report, warn=0.2, retrain=0.3, now=F.lit(now))
    return gauges.select("use_case", "model", "name", F.coalesce("column", F.lit("")).alias("column"), r6("value").alias("value"))


@query("sample_records", """
    SELECT '{"title":"' || title || '","p_size":' || p_size || '}' AS record
    FROM {listings} ORDER BY md5('42|' || p_partkey) LIMIT 25""")
def sample_records(t: Tables) -> DataFrame:
    return sampled(t.listings, ["title", "p_size"], ["p_partkey"], 25, seed=42)


@query("parse_exposition", """
    SELECT model, round(sum(value), 4) AS answered, max_by(model_version, event_id) AS served
    FROM {calls} WHERE source = 'model' GROUP BY 1""")
def parse_exposition(t: Tables) -> DataFrame:
    """Sample lines made of the calls, parsed back; the last line per model names the version."""
    line = F.concat(
        F.lit('uc_predictions_total{use_case="'), F.col("use_case"), F.lit('",model="'), F.col("model"),
        F.lit('",model_version="'), F.col("model_version"), F.lit('",source="'), F.col("source"), F.lit('"} '),
        F.col("value").cast("string"),
    )
    samples = parse_samples(t.calls.select("event_id", line.alias("line")))
    of_model = samples.filter(F.col("labels")["source"] == "model").select(
        "event_id", F.col("labels")["model"].alias("model"), F.col("labels")["model_version"].alias("served"), "value"
    )
    totals = of_model.groupBy("model").agg(F.round(F.sum("value"), 4).alias("answered"))
    return totals.join(latest(of_model, ["model"], "served", ["event_id"]), "model")


@query("fallback_totals", """
    SELECT use_case, count(*) AS fallbacks FROM {calls} WHERE source = 'fallback' GROUP BY 1""")
def fallback_totals(t: Tables) -> DataFrame:
    """Fallback counters of the sample lines, summed per use case."""
    line = F.format_string('uc_fallback_total{use_case="%s",model="%s",reason="error"} 1', F.col("use_case"), F.col("model"))
    samples = parse_samples(t.calls.filter(F.col("source") == "fallback").select(line.alias("line")))
    return samples.filter(F.col("name") == "uc_fallback_total").groupBy(F.col("labels")["use_case"].alias("use_case")).agg(
        F.sum("value").cast("long").alias("fallbacks")
    )


@query("registry_names", """
    SELECT DISTINCT use_case || '-' || model AS registered, use_case || '/' || model AS experiment FROM {calls}""")
def registry_names(t: Tables) -> DataFrame:
    return t.calls.select(
        registered_name("use_case", "model").alias("registered"), experiment_name("use_case", "model").alias("experiment")
    ).distinct()


_LINE = """CASE event_type
    WHEN 'purchase' THEN '{"id":' || event_id || ',"paid":' || CAST(user_id AS VARCHAR) || '.5,"k":' || json_extract_string(props, '$.k') || '}'
    WHEN 'error' THEN '{"id":' || event_id || ',"k":"' || json_extract_string(props, '$.k') || '!","code":' || (500 + user_id % 4) || '}'
    WHEN 'signup' THEN '{"id":' || event_id || ',"user":{"key":' || user_id || ',"tags":["a","' || event_type || '"]},"k":null}'
    WHEN 'view' THEN '{"id":' || event_id || ',"paid":' || user_id || ',"odd key":true}' ELSE props END"""


@query("jsonl_union", f"""
    WITH l AS (SELECT {_LINE} AS line FROM events)
    SELECT CAST(json_extract(line, '$.id') AS BIGINT) AS id, json_extract_string(line, '$.k') AS k, CAST(json_extract(line, '$.paid') AS DOUBLE) AS paid,
           CAST(json_extract(line, '$.code') AS BIGINT) AS code, CAST(json_extract(line, '$.user.key') AS BIGINT) AS user_key,
           json_extract_string(line, '$.user.tags[1]') AS tag, CAST(json_extract(line, '$."odd key"') AS BOOLEAN) AS odd FROM l""")
def jsonl_union(t: Tables) -> DataFrame:
    """Lines of five kinds with keys of several types, read without a schema: all keys of all lines."""
    path = fresh_path(t.spark, "lines")
    line = _LINE.replace("json_extract_string(", "get_json_object(").replace("AS VARCHAR", "AS STRING")
    t.events.selectExpr(f"{line} AS value").write.text(path)
    rows = read_json_union(t.spark, path)
    return rows.select("id", variant_text("k").alias("k"), "paid", "code", F.col("user.key").alias("user_key"),
                       F.get("user.tags", F.lit(1)).alias("tag"), F.col("odd key").alias("odd"))
