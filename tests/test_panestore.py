"""The pane store against one reading of everything."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from modelkeel.operators import drift
from modelkeel.plans.panestore import PaneStore

T0 = datetime(2024, 3, 1)
SCHEMA = "ts timestamp_ntz, model string, model_version string, price double, colour string"
WATCHED = ["price", "colour"]


def rows(seed, n, days, shift=0.0):
    rng = random.Random(seed)
    return [(T0 + timedelta(hours=rng.uniform(0, 24 * days)), rng.choice(["a", "a", "a", "b", None]), rng.choice("12"),
             rng.choice([None, rng.gauss(shift, 1)]), rng.choice(["red", "green", None])) for _ in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    store = PaneStore(spark, f"{tmp_path}/store", WATCHED, ["model"], pane="1 hour")
    store.freeze(spark.createDataFrame(rows(1, 400, 1), SCHEMA))
    return store


def land(spark, log, made):
    spark.createDataFrame(made, SCHEMA).coalesce(2).write.mode("append").parquet(log)


def listed(report):
    return sorted(((r["model"], r["model_version"], r["column"], r["n_live"], None if r["psi"] is None else round(r["psi"], 9)) for r in report.collect()), key=repr)


def test_runs_add_up_to_one_reading(spark, store, tmp_path):
    log, parts = f"{tmp_path}/log", [rows(2, 300, 3), rows(3, 200, 3, 2.0), rows(4, 100, 3)]
    assert store.absorb(_made(spark, log, parts[0]), spark.read.parquet(log).schema) == 2
    seen = [r["file"] for r in store.files().collect()]
    # what was read is not opened again: its files are no longer parquet
    for name in seen:
        Path(name.removeprefix("file:")).write_text("gone")
        Path(name.removeprefix("file:")).with_name("." + Path(name).name + ".crc").write_bytes(b"")
    for part in parts[1:]:
        schema = spark.createDataFrame([], SCHEMA).schema
        land(spark, log, part)
        assert store.absorb(log, schema) == 2
        assert store.absorb(log, schema) == 0
    assert store.files().count() == 6 and [r["run"] for r in store.files().select("run").distinct().orderBy("run").collect()] == [0, 1, 2]
    start, end = T0 + timedelta(days=1), T0 + timedelta(days=2, hours=5)
    everything = spark.createDataFrame([r for part in parts for r in part], SCHEMA).where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    edges, shares = drift.reference_bins(spark.createDataFrame(rows(1, 400, 1), SCHEMA), WATCHED, ["model"])
    counts = drift.bin_counts(everything, edges, WATCHED, ["model"], ["price"], ["model_version"]).withColumnRenamed("n", "c_live")
    want = drift.psi_of_counts(counts, edges, shares, ["model", "model_version"], ["model"], min_rows=20)
    assert listed(store.report(start, end, min_rows=20)) == listed(want) and want.count() >= 4


def _made(spark, log, part):
    land(spark, log, part)
    return log


def test_a_run_that_failed_is_repeated(spark, store, tmp_path, monkeypatch):
    log, part = f"{tmp_path}/log", rows(5, 100, 1)
    land(spark, log, part)
    schema = spark.read.parquet(log).schema
    empty = store.files()
    stop = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost"))
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", stop)  # the list of files is what is written last
        m.setattr(PaneStore, "files", lambda self: empty)
        with pytest.raises(RuntimeError):
            store.absorb(log, schema)
    assert store.files().count() == 0
    assert store.absorb(log, schema) == 2
    known = len([r for r in part if r[1] in ("a", "b")])
    counted = store.panes(T0, T0 + timedelta(days=1)).where("column = 'colour'").agg(F.sum("n")).first()[0]
    assert counted == known


def test_champions_only(spark, store, tmp_path):
    log = _made(spark, f"{tmp_path}/log", rows(6, 500, 1))
    store.absorb(log, spark.read.parquet(log).schema)
    champions = spark.createDataFrame([("a", 2), ("b", 1)], "model string, version int")
    report = store.report(T0, T0 + timedelta(days=1), champions=champions, min_rows=10)
    assert {(r["model"], r["model_version"]) for r in report.collect()} == {("a", "2"), ("b", "1")}
    few = store.levels(store.report(T0, T0 + timedelta(days=1), champions=champions, min_rows=10**6)).collect()
    assert {r["level"] for r in few} == {"skipped"}
    assert {r["level"] for r in store.levels(report).collect()} <= {"ok", "warn", "retrain"}
