import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modelkeel.operators import alerts as a, histograms as h, rates as r
from modelkeel.sources.metric_text import parse_samples

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_ratio_grades_are_strict(spark):
    rows = [(at(0), "u", i < 1) for i in range(5)] + [(at(6), "u", i < 2) for i in range(5)] + [(at(11), "u", False)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, use_case string, bad boolean")
    graded = r.graded(r.ratio_by_window(df, F.col("bad"), ["use_case"], "5 minutes"), "ratio", 0.05, 0.2)
    assert [(x["ratio"], x["severity"]) for x in graded.orderBy("window_start").collect()] == [
        (0.2, "warning"), (0.4, "critical"), (0.0, "ok")
    ]


def test_counter_resets(spark):
    values = [3, 5, 9, 2, 4, 4, 1]
    df = spark.createDataFrame([("s", at(i), i, v) for i, v in enumerate(values)], "k string, ts timestamp_ntz, id long, value long")
    for size in (2, 10**6):
        got = r.counter_increase(df, ["k"], "1 hour", rows_per_chunk=size).first()
        assert got["increase"] == (2 + 4 + 2 + 2 + 0 + 1)


def test_latest_and_staleness(spark):
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(30), 2.0), ("b", at(0), 3.0)], "k string, ts timestamp_ntz, v double")
    assert {x["k"]: x["v"] for x in r.latest(df, ["k"], "v", ["ts"]).collect()} == {"a": 2.0, "b": 3.0}
    now = F.lit(at(60)).cast("timestamp_ntz")
    assert {x["k"]: (x["age_seconds"], x["stale"]) for x in r.staleness(df, ["k"], now).collect()} == {
        "a": (1800, False), "b": (3600, True)
    }


def test_gauges_per_label_set(spark):
    lines = spark.createDataFrame([
        (1, 'up{a="1",b="2"} 1'), (2, 'up{b="2",a="1"} 5'), (3, 'up{a="1"} 7'), (4, "# HELP up"), (5, "up 2.5e3"), (6, "")
    ], "ts int, line string")
    last = {tuple(sorted((x["labels"] or {}).items())): x["value"] for x in r.latest_gauges(parse_samples(lines)).collect()}
    assert last == {(("a", "1"), ("b", "2")): 5.0, (("a", "1"),): 7.0, (): 2500.0}


def test_histogram_quantile(spark):
    values = [0.004] * 50 + [0.15] * 45 + [0.4] * 4 + [9.0]
    df = spark.createDataFrame([("u", v) for v in values], "k string, v double")
    got = {x["q"]: x["value"] for x in h.histogram_quantiles(h.bucket_counts(df, F.col("v"), ["k"]), ["k"], [0.5, 0.95, 0.99, 1.0]).collect()}
    assert got[0.5] == pytest.approx(0.005)
    assert got[0.95] == pytest.approx(0.2)
    assert got[0.99] == pytest.approx(0.5)
    assert got[1.0] == 2.0  # rank in +Inf: highest finite bound


def test_hold_needs_an_unbroken_run(spark):
    pattern = [1, 1, 0, 1, 1, 1, 1, 0, 1]
    rows = [("u", at(5 * i), float(v)) for i, v in enumerate(pattern)] + [("gap", at(0), 1.0), ("gap", at(10), 1.0), ("gap", at(15), 1.0)]
    grid = spark.createDataFrame(rows, "k string, window_start timestamp_ntz, v double")
    got = a.alert_holds(grid, ["k"], F.col("v") > 0, step_seconds=300, hold_seconds=600)
    firing = [(x["k"], x["end_s"] - x["start_s"]) for x in got.filter("firing").collect()]
    assert firing == [("u", 900)] and got.count() == 5


def test_canary_aborts_on_the_second_failure_of_four(spark):
    fails = [True, False, False, False, True, True, False]
    rows = [("u", "c", 30 * i, f) for i, f in enumerate(fails)] + [("u", "c", 30 * t, True) for t in (20, 24, 27)]
    checks = spark.createDataFrame(rows, "k string, check string, t long, failed boolean")
    got = [x["aborted"] for x in a.canary_verdicts(checks, ["k"]).orderBy("t").collect()]
    # an evaluation without a row counts among the four: 20 and 24 lie apart, 24 and 27 do not
    assert got == [False, False, False, False, False, True, True, False, False, True]


def test_quiet_canary_passes(spark):
    ratio = a.safe_ratio(F.lit(None).cast("long"), F.lit(0))
    assert spark.range(1).select(ratio).first()[0] == 0.0


def test_streaks(spark):
    rng = random.Random(5)
    rows = [("m" if rng.random() < 0.8 else "n", at(i // 3), i, rng.random() < 0.7) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, bad boolean")
    got = a.failure_streaks(df, ["k"], F.col("bad"), order=["ts", "id"], rows_per_chunk=9)
    state, want = {}, {}
    for k, _, i, bad in rows:
        state[k] = state.get(k, 0) + 1 if bad else 0
        want[i] = (state[k], state[k] >= 5)
    assert {x["id"]: (x["streak"], x["would_open"]) for x in got.collect()} == want


def test_outcome_mix(spark):
    df = spark.createDataFrame([("m", "ok"), ("m", "ok"), ("m", "timeout"), ("n", "error")], "k string, o string")
    got = {x["k"]: (x["ok"], x["timeout"], x["error"]) for x in r.outcome_mix(df, "k", "o", ["ok", "timeout", "error"]).collect()}
    assert got == {"m": (2, 1, 0), "n": (0, 0, 1)}
    assert math.isclose(sum(sum(v) for v in got.values()), 4)
