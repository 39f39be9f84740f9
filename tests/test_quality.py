import math

import pytest
from pyspark.sql import functions as F

from modelkeel.operators import quality as q
from modelkeel.operators.rows import delivery_rules, listing_rules, split_valid
from modelkeel.spec import ColumnCheck


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1.0, "x"), (2.0, "y"), (None, "z")], "a double, b string")


SCHEMA = {
    "a": ColumnCheck("number", min=2, max_null_ratio=0.1),
    "b": ColumnCheck("string", allowed=("x", "y")),
    "c": ColumnCheck("string"),
}


def test_violations_keep_their_wording_and_order(small):
    assert q.check_frame(small, SCHEMA) == [
        "a: null ratio 0.333 > 0.1", "a: min 1.0 < 2", "b: unexpected values ['z']", "c: missing column",
    ]
    rows = q.violations(small, SCHEMA).orderBy("position").collect()
    assert [r["position"] for r in rows] == [1, 2, 3, 4]


def test_clean_frame_passes(spark):
    fine = spark.createDataFrame([(2.0,), (3.0,)], "a double")
    assert q.check_frame(fine, {"a": ColumnCheck("number", min=2)}) == []
    q.require(fine, {"a": ColumnCheck("number", min=2)})


def test_gate_raises(small):
    with pytest.raises(q.QualityGateFailed) as caught:
        q.require(small, SCHEMA)
    assert len(caught.value.violations) == 4


def test_types_and_missing_values(spark):
    df = spark.createDataFrame([(1, True, "s", math.nan), (None, None, None, 2.0)], "i int, b boolean, s string, d double")
    assert q.check_frame(df, {"b": ColumnCheck("number", max_null_ratio=1)}) == ["b: expected number, got boolean"]
    assert q.check_frame(df, {"i": ColumnCheck("int", max_null_ratio=0.5), "b": ColumnCheck("bool", max_null_ratio=0.5)}) == []
    # NaN counts as null and never as a maximum
    assert q.check_frame(df, {"d": ColumnCheck("number", max=3)}) == ["d: null ratio 0.500 > 0.0"]
    assert q.check_frame(df, {"s": ColumnCheck("string", required=False, max_null_ratio=0.5, allowed=("s",))}) == []


def test_empty_frame_has_no_nulls(spark):
    empty = spark.createDataFrame([], "a double")
    assert q.check_frame(empty, {"a": ColumnCheck("number", min=2, max=3)}) == []
    assert q.null_ratios(empty).first()["null_ratio"] == 0.0


def test_five_unexpected_values_at_most(spark):
    df = spark.range(100).select(F.format_string("v%02d", "id").alias("x"))
    assert q.check_frame(df, {"x": ColumnCheck("string", allowed=("v00",))}) == [
        "x: unexpected values ['v01', 'v02', 'v03', 'v04', 'v05']"
    ]


def test_quarantine_of_requests(spark):
    rows = [("iPhone 13", 450.0), ("", 1.0), ("ok", 0.0), (None, 5.0), ("x" * 301, 5.0), ("y", 1_000_000.0), ("y", 1_000_000.5)]
    valid, bad = split_valid(spark.createDataFrame(rows, "title string, price double"), listing_rules())
    assert sorted(r["title"] for r in valid.collect()) == ["iPhone 13", "y"]
    assert sorted(tuple(r["reasons"]) for r in bad.collect()) == [("price",), ("price",), ("title",), ("title",), ("title",)]
    orders = [(1.0, 1.0, 0, "north"), (100.0, 50.0, 23, "west"), (0.0, 1.0, 0, "north"), (1.0, 1.0, 24, "moon"), (None, 1.0, 2, "east")]
    valid, bad = split_valid(
        spark.createDataFrame(orders, "distance_km double, weight_kg double, hour int, zone string"), delivery_rules()
    )
    assert valid.count() == 2
    assert sorted(tuple(r["reasons"]) for r in bad.collect()) == [("distance_km",), ("distance_km",), ("hour", "zone")]


def test_union_and_sets(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("z",)], "y string")
    assert {tuple(r) for r in q.union_records(a, b).collect()} == {(1, None), (None, "z")}
    assert q.shared_columns(("y", "x", "q"), a, a.withColumn("y", F.lit(1))) == ["x"]
