import math

import pytest
from pyspark.sql import functions as F

from modelkeel.functions import text, vectors
from modelkeel.functions.ids import request_id
from modelkeel.operators import features as f, scoring as s


@pytest.fixture(scope="module")
def answers(spark):
    rows = [
        ("iPhone 13 Pro 128GB very good condition", 450.0, "electronics", [0.05, 0.95]),
        ("iPhone 15 Pro Max URGENT whatsapp", 3.0, "electronics", None),
        ("plain chair", 80.0, "home", None),
        ("odd thing", 1.0, "unknown", None),
        ("single", 9.0, "books", [0.3]),
    ]
    return spark.createDataFrame(rows, "title string, price double, category string, proba array<double>")


def test_model_verdict_or_rules(spark, answers):
    got = {r["title"]: r for r in s.score_with_fallback(answers, s.medians_table(spark), "3").collect()}
    first = got["iPhone 13 Pro 128GB very good condition"]
    assert (first["source"], first["model_version"], first["is_suspicious"], first["score"], first["reasons"]) == ("model", "3", True, 0.95, [])
    second = got["iPhone 15 Pro Max URGENT whatsapp"]
    assert (second["source"], second["model_version"], second["is_suspicious"]) == ("fallback", "rules", True)
    assert second["reasons"] == ["price_below_category_floor", "suspicious_keyword"]
    assert (got["plain chair"]["score"], got["plain chair"]["reasons"]) == (0.05, [])
    assert got["odd thing"]["reasons"] == ["price_at_floor"]
    assert (got["single"]["score"], got["single"]["is_suspicious"]) == (0.3, False)


def test_argmax_takes_the_first_maximum(spark):
    rows = [([0.02, 0.9, 0.02, 0.02, 0.02, 0.02],), ([0.5, 0.5],), ([0.0] * 6 + [1.0],)]
    df = spark.createDataFrame(rows, "p array<double>")
    got = [r[0] for r in df.select(vectors.argmax_label(F.col("p"), s.CATEGORIES)).collect()]
    assert got == ["electronics", "books", "6"]


def test_answers_in_json(spark):
    df = spark.createDataFrame([("[0.1, 0.9]",), ("[0.4]",), ("0.7",)], "a string")
    got = [r[0] for r in df.select(vectors.positive_proba(vectors.as_proba(F.col("a")))).collect()]
    assert got == [0.9, 0.4, 0.7]


def test_records_and_ids(spark, answers):
    records = s.prediction_records(
        answers.withColumn("req", F.when(F.col("price") > 400, F.lit("given"))), ["title", "price"], model=F.lit("fraud"), version=F.lit("3"),
        prediction=F.col("category"), ts=F.lit("2024-01-01T00:00:00Z"), key=["title"], given_id=F.col("req"),
    )
    assert records.columns == ["ts", "request_id", "title", "price", "model", "model_version", "prediction", "source"]
    ids = {r["title"]: r["request_id"] for r in records.collect()}
    assert ids["iPhone 13 Pro 128GB very good condition"] == "given" and len(ids["single"]) == 12
    assert s.model_sourced(records.withColumn("source", F.lit("fallback"))).count() == 0
    assert spark.range(1).select(request_id(F.lit(""), F.lit("k"))).first()[0] != ""


def test_payload_is_a_list_of_column_lists(spark, answers):
    body = answers.limit(1).select(s.instances_payload(["title", "price"]).alias("b")).first()["b"]
    assert body == '{"instances":[{"title":["iPhone 13 Pro 128GB very good condition"],"price":[450.0]}]}'


def test_medians_from_the_reference(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 4.0), ("b", 5.0)], "category string, price double")
    assert {r["category"]: r["median"] for r in s.category_medians(df).collect()} == {"a": 2.0, "b": 4.5}


def test_text_helpers(spark):
    df = spark.createDataFrame([("Été au café à Nice",), ("a",), ("",)], "t string")
    got = [r[0] for r in df.select(text.unigrams_and_bigrams(F.col("t"))).collect()]
    assert got == [["été", "au", "café", "nice", "été au", "au café", "café nice"], [], []]
    slug = spark.range(1).select(text.run_id_slug(F.lit("manual__2024-01-01T00:00:00.5+00:00"))).first()[0]
    assert slug == "manual-2024-01-01-00-00-00-5-00-00"
    labels = spark.createDataFrame([("500",), ("5000",), ("404",)], "s string")
    assert labels.filter(text.matches_label(F.col("s"), "5..")).count() == 1
    codes = spark.createDataFrame([("closed",), ("half-open",), ("open",)], "s string")
    assert [r[0] for r in codes.select(vectors.circuit_code(F.col("s"))).collect()] == [0, 1, 2]


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red apple"), (2, "red apple pie"), (3, "blue sky")], "id int, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in f.tfidf_weights(docs, "id", "t").collect()}
    idf = math.log(4 / 3) + 1  # every kept term is in two of three documents
    raw = {"red": (1 + math.log(2)) * idf, "apple": idf, "red apple": idf}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == pytest.approx({k: v / norm for k, v in raw.items()})
    assert not any(k[0] == 3 for k in got)  # all of its terms are rare


def test_scaling_and_one_hot(spark):
    df = spark.createDataFrame([(0.0, "a"), (3.0, "b"), (8.0, "q"), (8.0, None)], "x double, z string")
    scaled = [r[0] for r in f.log1p_standardised(df, ["x"]).select("x_scaled").collect()]
    assert sum(scaled) == pytest.approx(0) and sum(v * v for v in scaled) == pytest.approx(4)
    hot = [tuple(r) for r in f.one_hot(df, "z", ["a", "b"]).select("z_a", "z_b").collect()]
    assert hot == [(1, 0), (0, 1), (0, 0), (0, 0)]
