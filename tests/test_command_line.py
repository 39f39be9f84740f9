"""The steps one by one, as a scheduler would call them."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from modelkeel.__main__ import execute
from modelkeel.sources.records import append_log, with_log_partitions
from test_pipeline import Toy


def test_steps_and_monitor(spark, tmp_path, monkeypatch):
    shared = ["--use-case", "test_pipeline:use_case", "--model", "weight", "--run-id", "r1", "--root", str(tmp_path)]

    def step(command, *more):
        return execute(spark, [command, *shared, *more])

    assert step("ingest", "--rows", "400")["rows"] == 400
    assert step("validate")["ok"] is True
    assert step("preprocess", "--reference-rows", "100")["train_rows"] == 300
    assert "train_mae" in step("train", "--trigger", "cron")
    assert step("evaluate")["promote"] is True
    assert step("register")["version"] == 1
    assert step("promote", "--version", "1")["previous_version"] is None
    records = step("sample", "--rows", "5", "--profile", "drift")
    assert len(records) == 5 and all(set(r) == {"size"} for r in records)

    now = datetime(2024, 5, 1, 12)
    live = Toy().ingest(spark, "weight", seed=9, rows=250, profile="drift").select(
        F.lit(now - timedelta(minutes=3)).alias("ts"), F.lit("id").alias("request_id"), "size", F.lit("weight").alias("model"),
        F.lit("1").alias("model_version"), F.col("weight").alias("prediction"), F.lit("model").alias("source"),
    )
    append_log(with_log_partitions(live, "toy"), f"{tmp_path}/predictions")
    found = step(
        "drift", "--log", f"{tmp_path}/predictions", "--features", "size:double", "--prediction-type", "double",
        "--now", now.isoformat(), "--dry-run",
    )
    assert found["level"] == "retrain" and found["rows"] == 250 and not found["retrain_requested"]
    with pytest.raises(LookupError):
        step("rollback")

    # the same records from a topic: only those since the bound, of this model
    rows = live.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    late = F.lit(now - timedelta(minutes=3)).cast("timestamp")
    shaped = rows.select(F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), late.alias("timestamp"),
                         F.lit("weight").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))
    other = shaped.withColumn("value", F.replace("value", F.lit('"model":"weight"'), F.lit('"model":"other"')))
    old = shaped.withColumn("timestamp", F.lit(now - timedelta(days=1)).cast("timestamp"))
    asked = []

    def read(session, bootstrap, topic, since):
        asked.append((bootstrap, topic, since))
        return shaped.unionByName(other).unionByName(old)

    monkeypatch.setattr("modelkeel.sources.topic.read_topic_window", read)
    drift = ["drift", "--source", "topic", "--features", "size:double", "--prediction-type", "double", "--now", now.isoformat(), "--dry-run"]
    again = step(*drift, "--bootstrap", "b:9092")
    assert (again["level"], again["rows"], again["psi"]) == (found["level"], found["rows"], found["psi"])
    minutes = found["window_minutes"]
    assert asked == [("b:9092", "predictions", int((now - timedelta(minutes=minutes)).replace(tzinfo=timezone.utc).timestamp() * 1000))]
    with pytest.raises(SystemExit):
        step(*drift)
