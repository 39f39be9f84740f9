"""Streams over several files and batches equal their batch twins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modelkeel.operators import alerts, rates
from modelkeel.streaming import common, state, windows

T0 = datetime(2024, 1, 1)


def files(spark, path, rows, schema, parts):
    """Write rows as ``parts`` files, in order."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size:(i + 1) * size]
        if chunk:
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def test_ratio_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(T0 + timedelta(minutes=i), rng.choice("ab"), rng.random() < 0.3) for i in range(600)]
    schema = files(spark, f"{tmp_path}/in", rows, "ts timestamp, k string, bad boolean", 4)
    stream = common.with_event_time(common.file_stream(spark, f"{tmp_path}/in", schema, max_files=1))
    got = common.drain_to_table(windows.ratio_stream(stream, F.col("bad"), ["k"], "30 minutes"), "t").collect()
    closed = rows[-1][0] - timedelta(minutes=10)
    batch = rates.ratio_by_window(spark.createDataFrame(rows, schema), F.col("bad"), ["k"], "30 minutes")
    want = {(r["window_start"], r["k"]): r["ratio"] for r in batch.collect() if r["window_start"] + timedelta(minutes=30) <= closed}
    assert {(r["window_start"], r["k"]): r["ratio"] for r in got} == want and want


def reference_breaker(calls, threshold, cooldown):
    events, failures, opened = [], 0, None
    for t, _, failed in sorted(calls):
        if opened is not None and t - opened < cooldown:
            continue
        half = opened is not None
        if half:
            events.append((t, "open", "half-open"))
        if failed:
            failures += 1
            if failures >= threshold:
                events.append((t, "half-open" if half else "closed", "open"))
                opened = t
        else:
            if half:
                events.append((t, "half-open", "closed"))
            failures, opened = 0, None
    return events


START = 600_000  # seconds; a stream takes rows of time 0 for late ones
END = ("end", 10**8)  # a key whose late row moves the watermark past everything else


def shuffled(rows, seed):
    """Rows in an order that differs from that of time by less than the lateness, the last one at the end."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[1] + rng.random() * 500)


def stream_of(spark, path, rows, schema, parts, lateness="1000 seconds"):
    """``rows`` (key, second, …) as ``parts`` micro-batches, with event time ``ts``."""
    kinds = files(spark, path, rows, schema, parts)
    stream = common.file_stream(spark, path, kinds, max_files=1).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    return common.with_event_time(stream, lateness=lateness)


def in_any_order(spark, tmp_path, rows, schema, run):
    """What ``run`` says of the rows in order, which must not depend on their order or on the batches."""
    end = (*END, *[type(x)() for x in rows[0][2:]])
    said = []
    for k, (order, parts) in enumerate([(rows, 1), (shuffled(rows, 1), 4)]):
        stream = stream_of(spark, f"{tmp_path}/in{k}", [*order, end], schema, parts)
        said.append(sorted(tuple(r) for r in common.drain_to_table(run(stream), "s").where("key <> 'end'").collect()))
    assert said[0] and all(x == said[0] for x in said[1:])
    return said[0]


def test_breaker_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["p1/m", "p2/m"]), START + i * 7, i, rng.random() < 0.75) for i in range(200)]
    run = lambda s: state.breaker_stream(s.withColumn("t", F.unix_micros("ts")))
    got = in_any_order(spark, tmp_path, rows, "key string, s long, id long, failed boolean", run)
    for key in ("p1/m", "p2/m"):
        want = reference_breaker([(r[1] * 1_000_000, *r[2:]) for r in rows if r[0] == key], 5, 30_000_000)
        assert sorted(r[1:] for r in got if r[0] == key) == sorted(want) and want


def test_hold_in_any_order(spark, tmp_path):
    pattern = [0, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0, 1]
    rows = [("u", START + 300 * i, bool(v)) for i, v in enumerate(pattern)]
    run = lambda s: state.hold_stream(s.withColumn("t", F.col("s")), 300, 600)
    got = in_any_order(spark, tmp_path, rows, "key string, s long, active boolean", run)
    assert sorted((at - START, event, since - START) for _, event, since, at in got) == [
        (900, "firing", 300), (1200, "resolved", 300), (2100, "firing", 1500), (3000, "resolved", 1500)
    ]
    grid = spark.createDataFrame(rows, "key string, t long, active boolean")
    batch = alerts.alert_holds(grid, ["key"], F.col("active"), step_seconds=300, hold_seconds=600)
    assert sorted(r["firing_from_s"] - START for r in batch.filter("firing").collect()) == [900, 2100]


def test_silence_in_any_order(spark, tmp_path):
    rows = [("m", START + 60 * x) for x in [0, 10, 20, 20, 100, 110, 400]]
    run = lambda s: state.silence_stream(s.withColumn("ms", F.unix_millis("ts")), 1800)
    got = in_any_order(spark, tmp_path, rows, "key string, s long", run)
    assert [(last // 1000 - START) // 60 for _, last in got] == [20, 110, 400]


def test_counters_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b"]), START + 11 * i, i, rng.randint(0, 50)) for i in range(200)]
    got = in_any_order(spark, tmp_path, rows, "key string, s long, id long, value long", lambda s: state.counter_increase_stream(s, 100))
    want, last = {}, {}
    for key, s, _, value in rows:
        before = last.get(key)
        pane = key, s // 100 * 100_000
        want[pane] = want.get(pane, 0) + (0 if before is None else value if value < before else value - before)
        last[key] = value
    assert {(k, p): n for k, p, n in got} == want
    batch = rates.counter_increase(
        spark.createDataFrame([(k, T0 + timedelta(seconds=s), i, v) for k, s, i, v in rows], "key string, ts timestamp_ntz, id long, value long"), ["key"], "100 seconds")
    assert sum(r["increase"] for r in batch.collect()) == sum(want.values())


def test_buffers_are_written_full_or_due(spark, tmp_path):
    rng, at, rows = random.Random(5), START, []
    for i in range(200):
        at += rng.choice([1, 1, 1, 2, 60, 200])
        rows.append((rng.choice(["a", "a", "a", "b"]), at, i, f"r{i}"))
    got = in_any_order(spark, tmp_path, rows, "key string, s long, id long, record string", lambda s: state.flush_stream(s, 6, 100))
    for key in ("a", "b"):
        want, held, first = [], [], None

        def write(cause):
            want.append((key, len(want), len(held), first * 1000, cause, list(held)))

        for _, s, _, record in (r for r in rows if r[0] == key):
            if held and s >= first + 100:
                write("age")
                held = []
            first = first if held else s
            held.append(record)
            if len(held) == 6:
                write("count")
                held = []
        if held:
            write("age")
        assert [(*x[:5], list(x[5])) for x in got if x[0] == key] == want and {x[4] for x in want} == {"age", "count"} or key == "b"


@pytest.mark.parametrize("label", ["a", "b"])
def test_fresh_folders(spark, label):
    from modelkeel.session import fresh_path

    assert fresh_path(spark, label) != fresh_path(spark, label)


class Kept:
    """A map state that counts its entries."""

    def __init__(self):
        self.rows = {}

    def updateValue(self, key, value):
        self.rows[key] = value


def test_a_key_holds_an_entry_for_many_rows():
    import pandas as pd

    machine = state.CounterIncrease(1000)
    machine.waiting = Kept()
    machine.handle = type("H", (), {"registerTimer": lambda self, at: None})()
    times = type("T", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    batch = pd.DataFrame({"key": "a", "ts": pd.Timestamp(0), "ms": range(10_000), "at": range(10_000), "id": 0, "value": 1})
    list(machine.handleInputRows(("a",), iter([batch, batch]), times))
    assert len(machine.waiting.rows) == 1


def test_a_slice_stays_small_when_the_table_grows(spark, tmp_path):
    from catalogue import streams
    from catalogue.base import Tables

    rows = [(i, T0 + timedelta(seconds=i * i), i, "error", 1.0, "{}") for i in range(400)] + [(400, None, 1, "view", 1.0, "{}")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    sizes = []
    calls = streams.call_slices(Tables(spark, str(tmp_path)), slice_rows=20).select("event_id", F.unix_micros("ts").alias("t"))

    def look(batch, number):
        got = sorted((r["t"], r["event_id"]) for r in batch.collect())
        assert not sizes or not got or got[0] >= sizes[-1][1]
        if got:
            sizes.append((len(got), got[-1]))

    common.drain_batches(calls, look, "slices")
    assert sum(n for n, _ in sizes) == 400 and max(n for n, _ in sizes) <= 25 and len(sizes) >= 16
