import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelkeel.operators import drift as d


def expected_numeric(ref, live):
    """Plain restatement of the definition for one numeric column."""
    whole = [x for x in [*ref, *live] if x is not None]
    if len({x for x in ref if x is not None}) <= 20:
        r, c = Counter(x for x in ref if x is not None), Counter(x for x in live if x is not None)
        keys = set(r) | set(c)
    else:
        k = math.ceil(math.log2(len(ref) + len(live)) + 1)
        lo, hi = min(whole), max(whole)
        width = (hi - lo) / k

        def place(x):
            return min(int((x - lo) // width), k - 1)

        r, c = Counter(place(x) for x in ref if x is not None), Counter(place(x) for x in live if x is not None)
        keys = set(r) | set(c)
    p = {b: max(r[b] / len(ref), 1e-4) for b in keys}
    q = {b: max(c[b] / len(live), 1e-4) for b in keys}
    return sum((p[b] - q[b]) * math.log(p[b] / q[b]) for b in keys)


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@pytest.mark.parametrize("few", [False, True])
def test_numeric_psi(spark, few):
    rng = np.random.default_rng(1)
    ref = [float(x) for x in (rng.integers(0, 8, 300) if few else rng.normal(10, 2, 300))]
    live = [float(x) for x in (rng.integers(2, 11, 200) if few else rng.normal(12, 3, 200))] + [None] * 5
    got = d.psi_by_column(frame(spark, ref), frame(spark, live), ["x"]).first()
    assert got["psi"] == pytest.approx(expected_numeric(ref, live))
    assert (got["n_ref"], got["n_live"]) == (300, 205)


def test_same_world_is_quiet_and_a_changed_one_is_not(spark):
    rng = np.random.default_rng(2)
    ref, same = [float(x) for x in rng.normal(20, 4, 2000)], [float(x) for x in rng.normal(20, 4, 600)]
    a = frame(spark, ref)
    assert d.psi_by_column(a, a, ["x"]).first()["psi"] == pytest.approx(0)
    assert d.psi_by_column(a, frame(spark, same), ["x"]).first()["psi"] < 0.2
    assert d.psi_by_column(a, frame(spark, [x * 3 for x in same]), ["x"]).first()["psi"] > 0.3


def test_categories_booleans_and_nulls(spark):
    ref = spark.createDataFrame([("a", True)] * 60 + [("b", False)] * 30 + [(None, True)] * 10, "c string, b boolean")
    live = spark.createDataFrame([("a", True)] * 20 + [("z", False)] * 20, "c string, b boolean")
    got = {r["column"]: r for r in d.psi_by_column(ref, live, ["c", "b"]).collect()}
    p, q = {"a": 0.6, "b": 0.3, "<null>": 0.1, "z": 1e-4}, {"a": 0.5, "b": 1e-4, "<null>": 1e-4, "z": 0.5}
    assert got["c"]["psi"] == pytest.approx(sum((p[k] - q[k]) * math.log(p[k] / q[k]) for k in p))
    assert got["c"]["bins"] == 4 and got["b"]["bins"] == 2


def test_all_models_in_one_job_equal_single_reports(spark):
    rng = np.random.default_rng(3)
    rows = [(m, float(x), str(int(x) % 3)) for m, mu in (("a", 5), ("b", 50), ("c", 1)) for x in rng.normal(mu, 2, 200)]
    rows += [("c", 1.0, "0")] * 50
    ref = spark.createDataFrame(rows, "m string, x double, c string")
    live = ref.withColumn("x", F.col("x") * 1.4).filter("m <> 'c' OR x > 0.5")
    many = {(r["m"], r["column"]): r["psi"] for r in d.psi_by_column(ref, live, ["x", "c"], ["m"]).collect()}
    for model in "abc":
        one = d.psi_by_column(ref.filter(F.col("m") == model), live.filter(F.col("m") == model), ["x", "c"]).collect()
        for r in one:
            assert many[model, r["column"]] == pytest.approx(r["psi"])


def test_mixed_few_and_many_values_per_model(spark):
    """One model's column is binned by value, the other's by width."""
    rows = [("few", float(i % 4)) for i in range(100)] + [("many", float(i)) for i in range(100)]
    ref = spark.createDataFrame(rows, "m string, x double")
    got = {r["m"]: r["bins"] for r in d.psi_by_column(ref, ref, ["x"], ["m"]).collect()}
    assert got == {"few": 4, "many": math.ceil(math.log2(200) + 1)}


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(0.2,), (0.2001,), (0.3,), (0.3001,)], "p double")
    assert [r[0] for r in df.select(d.level(F.col("p"))).collect()] == ["ok", "warn", "warn", "retrain"]


def test_windows_against_frozen_bins(spark):
    """Every overlapping window equals a direct computation over its rows."""
    rng = np.random.default_rng(4)
    ref = spark.createDataFrame([("m", float(x)) for x in rng.normal(10, 2, 400)], "model string, x double")
    live = spark.createDataFrame(
        [("m", float(x), int(i)) for i, x in enumerate(rng.normal(11, 3, 600))], "model string, x double, i long"
    ).withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, i * 6)"))
    edges, shares = d.reference_bins(ref, ["x"], ["model"])
    panes = d.live_panes(live, edges, ["x"], ["model"], ["x"], "10 minutes")
    got = d.window_psi(panes, edges, shares, ["model"], ["model"], window="30 minutes", slide="10 minutes").collect()
    e = edges.first()
    values = [(r["ts"], r["x"]) for r in live.collect()]
    reference = [r["x"] for r in ref.collect()]

    def place(x):
        return max(min(math.floor((x - e["lo"]) / e["width"]), e["k"] - 1), 0)

    assert len(got) == 8
    for row in got:
        inside = [x for ts, x in values if row["window_start"] <= ts < row["window_end"]]
        assert row["n_live"] == len(inside)
        if len(inside) < 200:
            assert row["psi"] is None and row["skipped"] == f"{len(inside)} rows < 200"
            continue
        p, q = Counter(map(place, reference)), Counter(map(place, inside))
        want = 0.0
        for b in set(p) | set(q):
            x, y = max(p[b] / 400, 1e-4), max(q[b] / len(inside), 1e-4)
            want += (x - y) * math.log(x / y)
        assert row["psi"] == pytest.approx(want)


def test_skip_reasons(spark):
    key = "use_case string, model string"
    models = spark.createDataFrame([("u", m) for m in "abcd"], key)
    champions, references = models.filter("model <> 'a'"), models.filter("model <> 'b'")
    rows = spark.createDataFrame([("u", "c", 3), ("u", "d", 500)], key + ", n long")
    got = {r["model"]: r["skipped"] for r in d.skip_reasons(models, champions, references, rows, comparable=1).collect()}
    assert got == {
        "a": "no champion yet", "b": "champion has no reference", "c": "3 rows < 200 or no comparable columns", "d": None,
    }
