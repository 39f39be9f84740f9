"""Trailing ranges against their definition: every evaluation from the samples in its range."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from modelkeel.operators import histograms as h, trailing as tr

T0 = datetime(2024, 1, 1)
BASE = int(T0.replace(tzinfo=timezone.utc).timestamp())
SCHEMA = "k string, ts timestamp_ntz, id long, value long"
STEP, RANGES = 30, [120, 600]


@pytest.fixture(scope="module", params=[3, 20_000], ids=["short blocks", "one block"])
def blocks(request):
    before, tr.BLOCK_STEPS = tr.BLOCK_STEPS, request.param
    yield request.param
    tr.BLOCK_STEPS = before


def samples(seed=1):
    """(key, second, id, value): clusters, gaps longer than a range, samples on grid times, ties, a null key, restarts."""
    rng = random.Random(seed)
    rows, i = [], 0
    for key in ("a", "b", None):
        at, value = 0.0, 0
        for _ in range(120):
            at += rng.choice([0, 0.000001, 1, 7.5, 30, 45, 60, 700])
            if rng.random() < 0.2:
                at = 30.0 * round(at / 30 + 1)
            value = rng.randint(0, 5) if rng.random() < 0.1 else value + rng.randint(0, 9)
            rows.append((key, round(at, 6), i, value))
            i += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(seconds=s), i, v) for k, s, i, v in rows], SCHEMA).repartition(5)


def evaluations(rows):
    """(key, time, range) with the samples that lie in it, in order."""
    out = {}
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for t in range(0, int(mine[-1][1]) + 700, STEP):
            for size in RANGES:
                inside = [r for r in mine if t - size < r[1] <= t]
                if inside:
                    out[key, BASE + t, size] = inside
    return out


def test_ratio(spark, blocks):
    rows = samples()
    got = tr.trailing_ratio(frame(spark, rows), F.col("value") % 3 == 0, ["k"], STEP, RANGES).collect()
    want = {at: (len(x), sum(r[3] % 3 == 0 for r in x)) for at, x in evaluations(rows).items()}
    assert {(r["k"], r["t"], r["range"]): (r["calls"], r["hits"]) for r in got} == want and len(got) == len(want)


def increase(inside, t, size):
    """Growth carried on to the bounds of the range, as written down in the docstring."""
    raw = sum(b[3] if b[3] < a[3] else b[3] - a[3] for a, b in zip(inside, inside[1:]))
    spent = inside[-1][1] - inside[0][1]
    if not spent:
        return raw, None
    mean = spent / (len(inside) - 1)
    before, after = inside[0][1] - (t - BASE - size), t - BASE - inside[-1][1]
    before = mean / 2 if before >= mean * 1.1 else before
    after = mean / 2 if after >= mean * 1.1 else after
    if raw > 0:
        before = min(before, spent * inside[0][3] / raw)
    return raw, raw * (spent + before + after) / spent


@pytest.mark.parametrize("chunk", [9, 10**6])
def test_increase(spark, blocks, chunk):
    rows = samples(2)
    got = {(r["k"], r["t"], r["range"]): r for r in tr.trailing_increase(frame(spark, rows), ["k"], STEP, RANGES, rows_per_chunk=chunk).collect()}
    want = {at: increase(x, at[1], at[2]) for at, x in evaluations(rows).items() if len(x) > 1}
    assert set(got) == set(want)
    for at, (raw, grown) in want.items():
        assert got[at]["raw"] == raw
        assert (got[at]["increase"] is None) == (grown is None)
        if grown is not None:
            assert got[at]["increase"] == pytest.approx(grown, rel=1e-6, abs=1e-6) and got[at]["rate"] == pytest.approx(grown / at[2], rel=1e-6, abs=1e-6)


def test_instant_values_go_stale(spark, blocks):
    rows = samples(3)
    got = {(r["k"], r["t"]): r["value"] for r in tr.instant(frame(spark, rows), ["k"], STEP, staleness=120).collect()}
    assert got == {at[:2]: x[-1][3] for at, x in evaluations(rows).items() if at[2] == 120}


def test_matching_drops_what_one_side_lacks(spark):
    schema = "t long, range long, k string, rate double"
    above = spark.createDataFrame([(60, 120, "a", 1.0), (60, 120, "b", 2.0), (60, 120, None, 3.0), (90, 120, "a", 4.0)], schema)
    below = spark.createDataFrame([(60, 120, "a", 4.0), (60, 120, "c", 2.0), (60, 120, None, 6.0), (90, 120, "a", 0.0), (60, 600, "b", 1.0)], schema)
    got = {(r["t"], r["k"]): r["ratio"] for r in tr.matched_ratio(above, below, ["k"], "rate").collect()}
    assert got == {(60, "a"): 0.25, (60, None): 0.5, (90, "a"): None}


def test_buckets_are_made_monotone(spark):
    rows = [("a", 0.1, 5.0), ("a", 0.2, 4.0), ("a", 0.5, 10.0), ("a", float("inf"), 10.0)]
    buckets = spark.createDataFrame(rows, "k string, le double, n double")
    got = {r["q"]: r["value"] for r in h.histogram_quantiles(buckets, ["k"], [0.5, 0.75]).collect()}
    assert got == {0.5: pytest.approx(0.1), 0.75: pytest.approx(0.35)}


def test_bucket_rates_correct_resets_by_bound(spark):
    values = {0.1: [0, 4, 1, 3], float("inf"): [0, 8, 2, 6]}  # restarted between the second and the third reading
    rows = [("p", le, T0 + timedelta(seconds=30 * i), i, v) for le, vs in values.items() for i, v in enumerate(vs, 1)]
    df = spark.createDataFrame(rows, "pod string, le double, ts timestamp_ntz, id long, value long")
    got = {(r["t"] - BASE, r["le"]): r["n"] for r in tr.bucket_rates(df, ["pod"], [], 30, [120]).where(F.col("t") == BASE + 120).collect()}
    assert got[120, 0.1] * 120 == pytest.approx(4 + 1 + 2) and got[120, float("inf")] * 120 == pytest.approx(8 + 2 + 4)


def test_ranges_fit_the_grid(spark):
    with pytest.raises(ValueError):
        tr.trailing(spark.createDataFrame([], "k string, t long, n long"), ["k"], 30, [45], sums=["n"])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert tr.trailing_ratio(df, F.col("value") > 0, ["k"], STEP, RANGES).collect() == []
    assert tr.trailing_increase(df, ["k"], STEP, RANGES).collect() == []
