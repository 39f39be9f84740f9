"""Projections, filters and row validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import Tables, query, sql_stamp, stamp
from modelkeel.functions.text import matches_label, run_id_slug as slug, text_length
from modelkeel.functions.vectors import coerce_number
from modelkeel.operators.drift import champion_rows as rows_of_champions, recent
from modelkeel.operators.rows import delivery_rules, listing_rules, split_valid, with_reasons
from modelkeel.operators.scoring import model_sourced, prediction_records
from modelkeel.sources.records import day_key, file_stamp


@query("project_features", "SELECT p_partkey, title, price, category FROM {listings}")
def project_features(t: Tables) -> DataFrame:
    return t.listings.select("p_partkey", "title", "price", "category")


@query("derive_text_len", "SELECT doc_id, length(text) AS title_len FROM documents")
def derive_text_len(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text_length("text").cast("long").alias("title_len"))


@query("champion_rows", """
    SELECT event_id, model FROM {calls} c WHERE model_version =
        (SELECT max(model_version) FROM {calls} k WHERE k.use_case = c.use_case AND k.model = c.model)""")
def champion_rows(t: Tables) -> DataFrame:
    """Rows answered by each model's champion, the latest version, compared as text."""
    champions = t.calls.groupBy("use_case", "model").agg(F.max("model_version").cast("int").alias("version"))
    return rows_of_champions(t.calls, champions).select("event_id", "model")


@query("recent_window", """
    SELECT event_id, """ + sql_stamp("ts") + """ AS at FROM events
    WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 4320 MINUTE""")
def recent_window(t: Tables) -> DataFrame:
    """The last three days before the newest event."""
    now = t.events.agg(F.max("ts")).first()[0]
    return recent(t.events, F.lit(now).cast("timestamp_ntz"), 4320).select("event_id", stamp("ts").alias("at"))


@query("coerce_numeric", """
    SELECT kind, count(*) AS n, count(v) AS numbers, coalesce(sum(v), 0) AS total FROM (
      SELECT event_id % 4 AS kind, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN -1.5 END AS v
      FROM events) GROUP BY 1""")
def coerce_numeric(t: Tables) -> DataFrame:
    """Text that is a number, a negative number, a word, or NaN."""
    text = (
        F.when(F.col("event_id") % 4 == 0, F.col("user_id").cast("string"))
        .when(F.col("event_id") % 4 == 1, F.lit("-1.5"))
        .when(F.col("event_id") % 4 == 2, F.col("event_type")).otherwise(F.lit("NaN"))
    )
    numbers = t.events.select((F.col("event_id") % 4).alias("kind"), coerce_number(text).alias("v"))
    return numbers.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("numbers"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total")
    )


@query("quarantine_rows", """
    SELECT doc_id, CASE WHEN length(text) BETWEEN 1 AND 300 THEN '' ELSE 'title' END
           || CASE WHEN n_chars - 200 > 0 AND n_chars - 200 <= 1000000 THEN '' ELSE 'price' END AS reasons
    FROM documents
    WHERE NOT (length(text) BETWEEN 1 AND 300 AND n_chars - 200 > 0 AND n_chars - 200 <= 1000000)""")
def quarantine_rows(t: Tables) -> DataFrame:
    """Documents as listing requests: whole texts as titles, a price that is not always positive."""
    requests = t.documents.select("doc_id", F.col("text").alias("title"), (F.col("n_chars") - 200).alias("price"))
    _, quarantine = split_valid(requests, listing_rules())
    return quarantine.select("doc_id", F.array_join("reasons", "").alias("reasons"))


@query("quarantine_enum", """
    WITH checked AS (SELECT *,
        CASE WHEN distance_km > 0 AND distance_km <= 100 THEN '' ELSE 'distance_km ' END
        || CASE WHEN weight_kg > 0 AND weight_kg <= 50 THEN '' ELSE 'weight_kg ' END
        || CASE WHEN hour >= 0 AND hour <= 23 THEN '' ELSE 'hour ' END
        || CASE WHEN zone IN ('north', 'south', 'east', 'west') THEN '' ELSE 'zone ' END AS reasons FROM {deliveries})
    SELECT reasons = '' AS valid, trim(reasons) AS reasons, count(*) AS n, max(l_orderkey) AS last_key
    FROM checked GROUP BY 1, 2""")
def quarantine_enum(t: Tables) -> DataFrame:
    checked = with_reasons(t.deliveries, delivery_rules())
    return checked.groupBy("valid", F.array_join("reasons", " ").alias("reasons")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("last_key")
    )


@query("model_sourced_only", "SELECT model, count(*) AS n FROM {calls} WHERE source = 'model' GROUP BY 1")
def model_sourced_only(t: Tables) -> DataFrame:
    return model_sourced(t.calls).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("label_regex_filter", """
    SELECT use_case, count(*) AS n FROM {calls}
    WHERE regexp_full_match(status, '5..') AND regexp_full_match(handler, '/v1/.*') GROUP BY 1""")
def label_regex_filter(t: Tables) -> DataFrame:
    wanted = matches_label(F.col("status"), "5..") & matches_label(F.col("handler"), "/v1/.*")
    return t.calls.filter(wanted).groupBy("use_case").agg(F.count(F.lit(1)).alias("n"))


@query("build_prediction_records", """
    SELECT """ + sql_stamp("ts") + """ AS at, substr(md5(CAST(event_id AS VARCHAR)), 1, 12) AS request_id,
           user_id, value, model, model_version, prediction, source FROM {calls}""")
def build_prediction_records(t: Tables) -> DataFrame:
    records = prediction_records(
        t.calls, ["user_id", "value"], model=F.col("model"), version=F.col("model_version"),
        prediction=F.col("prediction"), ts=F.col("ts"), key=["event_id"], source=F.col("source"),
    )
    return records.withColumn("at", stamp("ts")).drop("ts")


@query("day_partition_key", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H%M%S%f') AS file_stamp FROM events""")
def day_partition_key(t: Tables) -> DataFrame:
    return t.events.select("event_id", day_key("ts").alias("day"), file_stamp("ts").alias("file_stamp"))


@query("run_id_slug", """
    SELECT o_orderkey, lower(regexp_replace('Manual__' || """ + "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')" + """
           || '+00:00.' || o_orderpriority, '__|[_:+.T]', '-', 'g')) AS slug FROM orders""")
def run_id_slug(t: Tables) -> DataFrame:
    run_id = F.concat(
        F.lit("Manual__"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00."), F.col("o_orderpriority")
    )
    return t.orders.select("o_orderkey", slug(run_id).alias("slug"))
