import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from modelkeel.functions.ids import data_hash
from modelkeel.operators import split as s


def test_four_hundred_rows_leave_three_hundred(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "red").otherwise("blue").alias("colour"))
    train, holdout = s.train_holdout(df, "colour", ["id"], seed=7)
    assert (train.count(), holdout.count()) == (300, 100)
    assert train.join(holdout, "id").count() == 0
    shares = {r["colour"]: r["count"] for r in holdout.groupBy("colour").count().collect()}
    assert shares == {"red": 33, "blue": 67}  # 134 and 266 rows at a quarter, by largest remainder


def test_continuous_target_is_not_stratified(spark):
    df = spark.range(300).select("id", (F.col("id") * 1.5).alias("weight"))
    assert s.stratify_decision(df, "weight").first()["stratify"] is False
    assert s.stratify_decision(df.withColumn("weight", F.col("id") % 5), "weight").first()["stratify"] is True
    assert s.stratify_decision(df.withColumn("weight", F.lit("one")), "weight").first()["stratify"] is False
    train, holdout = s.train_holdout(df, "weight", ["id"], seed=1)
    assert (train.count(), holdout.count()) == (225, 75)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=60), st.sampled_from([0.1, 0.25, 0.5]))
def test_split_is_exact_disjoint_and_complete(spark, labels, ratio):
    df = spark.createDataFrame(list(enumerate(labels)), "id int, y string")
    marked = s.with_holdout(df, ["id"], seed=3, ratio=ratio, strata=["y"]).collect()
    assert len(marked) == len(labels)
    inside = Counter(r["y"] for r in marked if r["is_holdout"])
    assert sum(inside.values()) == math.ceil(round(len(labels) * ratio, 6))
    for label, n in Counter(labels).items():
        share = math.ceil(round(len(labels) * ratio, 6)) * n / len(labels)
        assert math.floor(share) <= inside[label] <= math.ceil(share)


def test_sample_and_seed(spark):
    df = spark.range(500)
    first = {r["id"] for r in s.frozen_sample(df, ["id"], 50, seed=1).collect()}
    again = {r["id"] for r in s.frozen_sample(df.repartition(7), ["id"], 50, seed=1).collect()}
    other = {r["id"] for r in s.frozen_sample(df, ["id"], 50, seed=2).collect()}
    assert len(first) == 50 and first == again != other
    assert s.frozen_sample(df, ["id"], 10_000, seed=1).count() == 500


def test_sampled_records_hold_the_features_only(spark):
    import json

    df = spark.range(30).select("id", F.lit("t").alias("text"), F.col("id").cast("double").alias("size"))
    records = [json.loads(r["record"]) for r in s.sample_records(df, ["text", "size"], ["id"], 5, seed=1).collect()]
    assert len(records) == 5 and all(set(r) == {"text", "size"} for r in records)


def test_hash_ignores_row_order_but_not_content_or_copies(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("t"), (F.col("id") / 3).alias("d"))
    base = data_hash(df).first()["data_hash"]
    assert len(base) == 16
    assert data_hash(df.orderBy(F.desc("id")).repartition(5)).first()["data_hash"] == base
    assert data_hash(df.filter("id > 0")).first()["data_hash"] != base
    assert data_hash(df.unionByName(df.limit(1))).first()["data_hash"] != base
    assert data_hash(df.withColumn("t", F.when(F.col("id") != 5, F.col("t")))).first()["data_hash"] != base
    assert data_hash(df.limit(0)).first()["rows"] == 0


def test_category_share(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "c string")
    assert s.category_share(df, F.col("c") == "a").first()["share"] == pytest.approx(0.5)


def test_content_hash_is_exact(spark):
    values = [0.00001, 0.00004, 1.0, 2.0**29, 2.0**29 - 2.0**-23, 5e-324, 1.7976931348623157e308, float("nan"), float("inf"), float("-inf"), None, -1.0, 0.0, 0.1, 0.1 + 2**-56]
    hashes = {data_hash(spark.createDataFrame([(v,)], "x double")).first()["data_hash"] for v in values}
    assert len(hashes) == len(values)
    texts = [("\\N", "a"), (None, "a"), ("", "a"), ("a", None), ("a\x1f", ""), ("a", "\x1f"), ("~", "a"), ("1:a", ""), ("", "1:a")]
    assert len({data_hash(spark.createDataFrame([t], "x string, y string")).first()["data_hash"] for t in texts}) == len(texts)
    one = spark.createDataFrame([(1, 2)], "x long, y long")
    assert len({data_hash(one.toDF(*n)).first()["data_hash"] for n in (("x", "y"), ("y", "x"))}) == 2
    assert data_hash(one).first()["data_hash"] != data_hash(one.select(F.col("x").cast("int"), "y")).first()["data_hash"]


def test_cap_counts_equal_rows(spark):
    from modelkeel.operators.split import cap_rows

    equal = spark.range(100).select(F.lit(7).alias("x"), F.lit("a").alias("y"))
    assert cap_rows(equal, equal.columns, 10, seed=1).count() == 10
    mixed = equal.unionByName(spark.range(50).select(F.col("id").cast("int").alias("x"), F.lit("b").alias("y")))
    for n in (0, 1, 60, 149, 150, 400):
        assert cap_rows(mixed, mixed.columns, n, seed=1).count() == min(n, 150)
    assert cap_rows(equal, equal.columns, None, seed=1).count() == 100
