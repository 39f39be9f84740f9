"""Chunked order computations against brute force, with hot keys, ties and null keys."""

import random

import pytest
from pyspark.sql import functions as F

from modelkeel.operators.histograms import exact_quantiles
from modelkeel.operators.ordered import lag_chunked, running_sum_chunked, streak_chunked, with_chunks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = [(rng.choice("aaab"), 5 if rng.random() < 0.4 else rng.randint(0, 30), i, rng.random() < 0.6) for i in range(300)]
    return [*made, (None, 3, 1000, True), (None, 4, 1001, True)]


@pytest.mark.parametrize("size", [7, 50, 10**6])
def test_lag_sum_and_streak(spark, rows, size):
    df = spark.createDataFrame(rows, "k string, t long, id long, hit boolean")
    lags = {r.id: r.x for r in lag_chunked(df, ["k"], ["t", "id"], "id", "x", rows_per_chunk=size).collect()}
    sums = {r.id: r.x for r in running_sum_chunked(df, ["k"], ["t", "id"], F.col("id"), "x", rows_per_chunk=size).collect()}
    runs = {r.id: r.x for r in streak_chunked(df, ["k"], ["t", "id"], F.col("hit"), "x", rows_per_chunk=size).collect()}
    assert len(lags) == len(sums) == len(runs) == len(rows)
    for key in ("a", "b", None):
        previous, total, streak = None, 0, 0
        for _, _, ident, hit in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total += ident
            streak = streak + 1 if hit else 0
            assert (lags[ident], sums[ident], runs[ident]) == (previous, total, streak)
            previous = ident


def test_chunks_bound_ties(spark):
    """A time stamp that holds most rows is cut along the tie-breaker."""
    df = spark.range(1000).select(F.lit(7).alias("t"), F.col("id"))
    sizes = [r["count"] for r in with_chunks(df, ["t", "id"], rows_per_chunk=100).groupBy("chunk").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 250


@pytest.mark.parametrize("kind, values", [
    ("long", [2**60] * 12 + [2**60 + 1] * 5 + [2**60 + 2, 2**60 - 1]),  # one double holds them all
    ("double", [0.5] * 9 + [0.7] * 2 + [0.1, 1.4, 1.6]),  # less than one apart from a tied value
    ("long", [None, None, 1, 2, 2, 2, 2, 2]),
])
def test_tied_values_and_their_neighbours(spark, kind, values):
    rng = random.Random(8)
    rows = [("k", rng.choice(values), i) for i in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, f"k string, t {kind}, id long")
    got = {r.id: r.x for r in running_sum_chunked(df, ["k"], ["t", "id"], F.col("id"), "x", rows_per_chunk=20).collect()}
    total = 0
    for _, t, ident in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        total += ident
        assert got[ident] == total
    chunks = with_chunks(df, ["t", "id"], rows_per_chunk=20).groupBy("chunk").count()
    assert chunks.count() > 8


def test_quantiles_in_many_chunks(spark, monkeypatch):
    import numpy as np

    from modelkeel.operators import histograms, ordered

    cut = ordered.running_sum_chunked
    monkeypatch.setattr(histograms, "running_sum_chunked", lambda *a, **k: cut(*a, rows_per_chunk=5, **k))
    rng = random.Random(4)
    rows = [(rng.choice("aab"), float(rng.randint(0, 40))) for _ in range(200)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], [0.1, 0.5, 0.99]).collect()
    for r in got:
        assert r["value"] == pytest.approx(float(np.quantile([v for k, v in rows if k == r["k"]], r["q"])))
    assert len(got) == 6


def test_exact_quantiles(spark):
    import numpy as np

    values = [1.0, 1.0, 1.0, 2.0, 5.0, 9.0, 9.5]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0)], "k string, v double")
    got = {(r.k, r.q): r.value for r in exact_quantiles(df, "v", ["k"], [0.0, 0.5, 0.9, 1.0]).collect()}
    for q in (0.0, 0.5, 0.9, 1.0):
        assert got["a", q] == pytest.approx(float(np.quantile(values, q)))
        assert got["b", q] == 3.0
    whole = exact_quantiles(df, "v", [], [0.5]).first()
    assert whole["value"] == pytest.approx(float(np.quantile([*values, 3.0], 0.5)))
