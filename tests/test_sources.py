import json
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from modelkeel.session import fresh_path, shared_dir
from modelkeel.sources import datasets, layout, metric_text, records, sinks, topic
from modelkeel.schema import columns


class FakeSession:
    """Just the two things the lookup reads."""

    def __init__(self, master, folder=None):
        self.sparkContext = SimpleNamespace(master=master)
        self.conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" and folder else default)


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(FakeSession("spark://host", "hdfs://nn/check/")) == "hdfs://nn/check"
    assert fresh_path(FakeSession("yarn", "/shared"), "x").startswith("/shared/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession("yarn"))
    assert shared_dir(spark) == shared_dir(spark)


def test_uris(spark):
    assert layout.parse_object_uri("s3://bucket/a/b.parquet") == ("bucket", "a/b.parquet")
    with pytest.raises(ValueError):
        layout.parse_object_uri("file:///x")
    df = spark.createDataFrame([("s3://bucket/a/b",), ("s3://only",), ("http://x/y",)], "u string")
    got = [tuple(r) for r in df.select(layout.uri_bucket("u"), layout.uri_key("u")).collect()]
    assert got == [("bucket", "a/b"), ("only", ""), ("", "")]


def test_datasets_are_written_once(spark, tmp_path):
    path = datasets.write_dataset(spark.range(5), f"{tmp_path}/run/raw")
    assert datasets.read_dataset(spark, path).count() == 5
    with pytest.raises(Exception, match="already exists"):
        datasets.write_dataset(spark.range(1), path)


def test_file_bound_is_inclusive(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/t")
    listed = datasets.files_since(spark, f"{tmp_path}/t", F.lit(0).cast("timestamp"), glob="*.parquet")
    stamp = listed.first()["modified"]
    exact = F.lit(stamp)
    assert datasets.files_since(spark, f"{tmp_path}/t", exact, glob="*.parquet").count() == 1
    later = F.lit(stamp + timedelta(milliseconds=1))
    assert datasets.files_since(spark, f"{tmp_path}/t", later, glob="*.parquet").count() == 0
    assert datasets.read_rows_since(spark.read.parquet(f"{tmp_path}/t"), exact).count() == 3
    assert datasets.read_rows_since(spark.read.parquet(f"{tmp_path}/t"), later).count() == 0


def test_json_lines_skip_blanks_and_fill_keys(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"model": "m", "price": 1.5}\n\n{"model": "n", "other": 1}\n')
    df = records.read_json_lines(spark, [str(tmp_path / "a.jsonl")], records.record_schema({"price": "double"}))
    assert sorted((r["model"], r["price"]) for r in df.collect()) == [("m", 1.5), ("n", None)]


def test_log_is_partitioned_by_day_and_pruned(spark, tmp_path):
    rows = [(datetime(2024, 1, d, 12), "m", "1") for d in (1, 2, 3)]
    made = spark.createDataFrame(rows, "ts timestamp, model string, model_version string")
    records.append_log(records.with_log_partitions(made, "uc"), f"{tmp_path}/log")
    records.append_log(records.with_log_partitions(made, "uc"), f"{tmp_path}/log")
    log = records.read_log(spark, f"{tmp_path}/log", records.record_schema({}))
    since = F.lit(datetime(2024, 1, 2, 18))
    window = records.log_window(log, since)
    assert window.count() == 2 and log.count() == 6
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "date" in plan.split("PartitionFilters")[1][:200]
    assert records.day_key is not None and made.select(records.file_stamp("ts")).first()[0] == "120000000000"


TOPIC = [(0, 1, "categorizer", 10), (0, 2, "fraud", 11), (0, 3, "categorizer", 12), (0, 4, "categorizer", 13)]


def test_topic_window(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(p, o, t0 + timedelta(minutes=o), m, json.dumps({"model": m, "price": price})) for p, o, m, price in TOPIC]
    df = spark.createDataFrame(rows, topic.TOPIC_ROW)
    marks = spark.createDataFrame([(0, 4), (1, 0)], "partition int, high_mark long")
    schema = columns(model="string", price="double")
    since = F.lit(t0 + timedelta(minutes=1))
    got = topic.decode_window(df, schema, since, model="categorizer", high_marks=marks)
    assert sorted(r["price"] for r in got.collect()) == [10.0, 12.0]
    assert topic.decode_window(df, schema, F.lit(t0 + timedelta(days=1)), high_marks=marks).count() == 0
    assert topic.decode_window(df, schema, since).count() == 4


def test_topic_options_and_rows(spark):
    options = topic.window_options("host:9092", "predictions", 1704067200000)
    assert options["startingTimestamp"] == "1704067200000" and options["endingOffsets"] == "latest"
    assert options["startingOffsetsByTimestampStrategy"] == "latest"
    row = topic.to_topic_rows(spark.createDataFrame([("fraud", True)], "model string, prediction boolean")).first()
    assert (row["topic"], row["key"], json.loads(row["value"])) == ("predictions", "fraud", {"model": "fraud", "prediction": True})


def test_a_failing_sink_is_a_row(spark, tmp_path):
    def broken(batch, batch_id):
        raise OSError("down")

    targets = {"broken": broken, "table": sinks.parquet_sink(f"{tmp_path}/t")}
    for _ in range(2):  # a repeated batch replaces its own output
        outcome = {r["sink"]: (r["ok"], r["error"]) for r in sinks.emit(spark.range(4), 7, targets).collect()}
    assert outcome["table"] == (True, "") and outcome["broken"] == (False, "OSError: down")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4


def test_step_results(spark, tmp_path):
    datasets.append_step_result(spark, f"{tmp_path}/r", "run1", "evaluate", {"promote": True, "rows": 3, "psi": {"a": 1}, "cols": ["x"], "note": "a b"})
    got = {r["name"]: r["value"] for r in datasets.scalar_entries(spark.read.parquet(f"{tmp_path}/r")).collect()}
    assert {k: got[k] for k in ("promote", "rows", "note")} == {"promote": "true", "rows": "3", "note": "a b"}
    assert "psi" not in got and "cols" not in got


def test_json_document(spark, tmp_path):
    datasets.write_json_document(spark, f"{tmp_path}/d", {"b": [1, 2], "a": "x"})
    assert datasets.read_json_document(spark, f"{tmp_path}/d") == {"a": "x", "b": [1, 2]}


def test_drift_gauges(spark):
    report = spark.createDataFrame([("u", "m", "x", 0.1, 300), ("u", "m", "y", 0.4, 300)], "use_case string, model string, column string, psi double, n_live long")
    now = F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc))
    gauges = metric_text.drift_gauges(report, warn=0.2, retrain=0.3, now=now)
    got = {(r["name"], r["column"]): r["value"] for r in gauges.collect()}
    assert got["ct_drift_psi", "y"] == 0.4 and got["ct_drift_detected", None] == 1.0
    assert got["ct_drift_window_rows", None] == 300 and got["ct_drift_last_run_timestamp_seconds", None] == 1704067200
    rows = metric_text.as_metric_rows(gauges, now).collect()
    assert {tuple(sorted(r["labels"])) for r in rows} == {("column", "model", "use_case"), ("model", "use_case")}
