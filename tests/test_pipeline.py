"""The whole loop on a toy use case, gates included."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from modelkeel import ColumnCheck, ModelSpec, UseCase, load_use_case
from modelkeel.operators import metrics
from modelkeel.operators.quality import QualityGateFailed
from modelkeel.plans import monitor, pipeline as p, training as tr
from modelkeel.plans.use_cases import Deliveries, Listings

WORDS = {"red": ["apple", "cherry", "fire"], "blue": ["sky", "sea", "ink"]}


class Toy:
    """Colour from text and size, weight from size."""

    name = "toy"
    models = {
        "colour": ModelSpec("colour", "colour", ("text", "size"), "f1_macro", drift_columns=("size",)),
        "weight": ModelSpec("weight", "weight", ("size",), "mae", higher_is_better=False, drift_columns=("size",)),
    }

    def ingest(self, spark, model, *, profile=None, seed=42, rows=None):
        rng = random.Random(seed)
        made = []
        for _ in range(rows or 400):
            colour = rng.choice(["red", "blue"])
            size = rng.gauss(10 if colour == "red" else 20, 2) * (3 if profile == "drift" else 1)
            made.append((f"{rng.choice(WORDS[colour])} {rng.choice(WORDS[colour])}", size, colour, size * 1.5 + rng.gauss(0, 0.5)))
        return spark.createDataFrame(made, "text string, size double, colour string, weight double")

    def schema(self, model):
        return {
            "text": ColumnCheck("string"), "size": ColumnCheck("number", min=0),
            "colour": ColumnCheck("string", allowed=("red", "blue")), "weight": ColumnCheck("number"),
        }

    def build_model(self, model, rows):
        if model == "weight":
            return tr.linear_pipeline(["size"], "weight")
        return tr.multiclass_text_pipeline("text", ["size"], "colour", rows, max_iter=20, dimensions=256)

    def evaluate(self, model, fitted, df):
        answered = fitted.transform(df)
        if model == "weight":
            return metrics.evaluate(answered, metrics.regression(F.col("weight"), F.col("prediction")))
        rows = metrics.metrics_for_task(answered, "classification", "label", "prediction").collect()
        return {r["metric"]: r["value"] for r in rows}


class Negative(Toy):
    def ingest(self, spark, model, **options):
        return super().ingest(spark, model, **options).withColumn("size", F.lit(-1.0))


use_case = Toy


def test_plug_in_loading():
    assert isinstance(load_use_case("test_pipeline:use_case"), UseCase)
    with pytest.raises(TypeError):
        load_use_case("math:pi")
    with pytest.raises(ValueError):
        load_use_case("")


def test_full_loop_then_refusal_then_rollback_and_drift(spark, tmp_path):
    root = str(tmp_path)
    first = p.run_pipeline(p.Run(spark, Toy(), "colour", "run1", root), rows=400, reference_rows=100, trigger="test")
    assert first["ingest"]["rows"] == 400 and first["validate"]["ok"]
    assert (first["preprocess"]["train_rows"], first["preprocess"]["holdout_rows"]) == (300, 100)
    assert first["evaluate"]["promote"] and first["evaluate"]["reason"] == "no champion yet"
    assert first["evaluate"]["candidate"] > 0.9
    assert first["register"]["version"] == 1 and first["register"]["serving_uri"] == f"{root}/models/toy/colour/v1"
    served = PipelineModel.load(first["register"]["serving_uri"])
    frame = spark.createDataFrame([("sky sea", 20.0, "blue")], "text string, size double, colour string")
    scored = tr.score(served, frame, version="1", labels=tr.class_labels(served)).first()
    assert scored["prediction"] == "blue" and scored["model_version"] == "1"

    # the same data again: no improvement, nothing registered
    run2 = p.Run(spark, Toy(), "colour", "run2", root)
    second = p.run_pipeline(run2, rows=400, reference_rows=100)
    assert not second["evaluate"]["promote"] and second["evaluate"]["champion_version"] == 1
    assert "register" not in second and "did not improve" in second["evaluate"]["reason"]

    with pytest.raises(p.NothingToRollBack):
        p.rollback(run2)
    assert p.register(run2)["version"] == 2
    assert p.promote(run2, version=2)["previous_version"] == 1
    assert p.rollback(run2)["version"] == 1
    assert p.champion(run2)["version"] == 1
    lineage = p.champion(run2)["tags"]
    assert len(lineage["data_hash"]) == 16 and lineage["git_commit"] == "unknown" and lineage["pipeline_run"] == "run1"

    # monitoring: quiet, drifted, too few, and another version's traffic
    now = datetime(2024, 1, 1, 12)
    live = Toy().ingest(spark, "colour", seed=5, rows=300).select(
        F.lit(now - timedelta(minutes=5)).alias("ts"), F.lit("colour").alias("model"), F.lit("1").alias("model_version"),
        "text", "size", F.col("colour").alias("prediction"),
    )
    quiet = monitor.check_model(run2, live, now)
    assert quiet["level"] == "ok" and quiet["max_psi"] < 0.2 and set(quiet["psi"]) == {"size", "prediction"}
    moved = monitor.check_model(run2, live.withColumn("size", F.col("size") * 3), now)
    assert moved["level"] == "retrain" and moved["psi"]["size"] > 0.3 and moved["retrain_requested"]
    busy = spark.createDataFrame([("toy", "colour", "Running")], "use_case string, model string, phase string")
    assert not monitor.check_model(run2, live.withColumn("size", F.col("size") * 3), now, in_flight=busy)["retrain_requested"]
    assert monitor.check_model(run2, live.limit(20), now)["skipped"].startswith("20 rows < 200")
    assert monitor.check_model(run2, live.withColumn("model_version", F.lit("2")), now)["rows"] == 0
    assert monitor.check_model(run2, live, now + timedelta(hours=1))["rows"] == 0
    other = p.Run(spark, Toy(), "weight", "none", root)
    assert monitor.check_model(other, live, now)["skipped"] == "no champion yet"
    samples = spark.read.parquet(f"{root}/tables/metrics")
    assert samples.filter("name = 'ct_drift_psi'").count() == 6


def test_bad_data_stops_the_pipeline(spark, tmp_path):
    run = p.Run(spark, Negative(), "colour", "bad", str(tmp_path))
    with pytest.raises(QualityGateFailed, match="min -1.0 < 0"):
        p.run_pipeline(run, rows=50)
    recorded = spark.read.parquet(f"{tmp_path}/tables/step_results").filter("step = 'validate'").first()
    assert '"ok": false' in recorded["result_json"]


def test_regression_is_gated_on_mae(spark, tmp_path):
    done = p.run_pipeline(p.Run(spark, Toy(), "weight", "reg1", str(tmp_path)), rows=300, reference_rows=50)
    assert done["evaluate"]["promote"] and done["evaluate"]["primary_metric"] == "mae"
    assert done["evaluate"]["candidate"] < 1.0 and done["preprocess"]["train_rows"] == 225


def test_copies_do_not_bend_the_split(spark, tmp_path):
    """A third of the rows are copies of one row; the quota still holds."""
    run = p.Run(spark, Toy(), "colour", "copies", str(tmp_path))
    frame = Toy().ingest(spark, "colour", rows=200)
    one = frame.limit(1)
    frame = frame.unionByName(one.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("n"))
    p.write_dataset(frame, run.path("raw"))
    done = p.preprocess(run, reference_rows=100)
    assert (done["train_rows"], done["holdout_rows"]) == (225, 75)


def test_landing_the_same_rows_again_gives_the_same_split(spark, tmp_path):
    parts = []
    for run_id in ("a", "b"):
        run = p.Run(spark, Toy(), "colour", run_id, str(tmp_path))
        p.ingest(run, rows=200)
        p.preprocess(run, reference_rows=40)
        parts.append([sorted(map(tuple, run.read(n).collect())) for n in ("train", "holdout", "reference")])
    assert parts[0] == parts[1] and [len(x) for x in parts[0]] == [150, 50, 40]


def listing_rows(spark, profile, seed):
    rng = random.Random(seed)
    words = {"electronics": "phone laptop charger", "books": "novel atlas story", "kids": "toy crib doll",
             "home": "lamp sofa table", "fashion": "shirt dress boots", "sports": "ball racket skates"}
    rows = []
    for _ in range(600):
        category = rng.choice(sorted(words))
        fraud = rng.random() < 0.15
        title = f"{rng.choice(words[category].split())} {rng.choice(words[category].split())}" + (" urgent whatsapp" if fraud else "")
        rows.append((title, max(rng.lognormvariate(3, 1) * (0.05 if fraud else 1), 0.01), category, fraud))
    return spark.createDataFrame(rows, "title string, price double, category string, is_fraud boolean")


def test_listing_models(spark, tmp_path):
    listings = Listings(listing_rows)
    assert isinstance(listings, UseCase)
    frame = listings.ingest(spark, "fraud", rows=400)
    assert frame.count() == 400 and "title_len" in frame.columns
    for model, metric in (("categorizer", "f1_macro"), ("fraud", "f1")):
        fitted = _small(listings, model).fit(frame)
        assert listings.evaluate(model, fitted, frame)[metric] > 0.7


def _small(listings, model):
    if model == "categorizer":
        return tr.multiclass_text_pipeline("title", ["price"], "category", 400, max_iter=30, dimensions=512)
    from modelkeel.plans.use_cases import BalancedText

    return BalancedText(tr.binary_text_pipeline("title", ["price"], 400, max_iter=30, dimensions=512), "is_fraud")


def test_delivery_schema(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(0.2, 30), rng.uniform(0.1, 20), rng.randrange(24), rng.choice(["north", "south", "east", "west"])) for _ in range(300)]

    def source(spark, profile, seed):
        return spark.createDataFrame(rows, "distance_km double, weight_kg double, hour int, zone string").withColumn(
            "eta_minutes", 5 + F.col("distance_km") * 3
        )

    deliveries = Deliveries(source)
    frame = deliveries.ingest(spark, "eta")
    from modelkeel.operators.quality import check_frame

    assert check_frame(frame, deliveries.schema("eta")) == []
    fitted = tr.gbt_pipeline(["distance_km", "weight_kg", "hour"], ["zone"], "eta_minutes", iterations=5).fit(frame)
    got = deliveries.evaluate("eta", fitted, frame)
    assert got["r2"] > 0.5 and got["mae"] < got["rmse"]


def test_saved_pipelines_load(spark, tmp_path):
    df = spark.createDataFrame([("red apple", 1.0), ("blue sky", 2.0)] * 4, "t string, n double")
    model = Pipeline(stages=tr.text_stages("t", "v", 64)).fit(df)
    model.write().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    assert [r["v"] for r in again.transform(df).collect()] == [r["v"] for r in model.transform(df).collect()]


def test_scoring_a_stream_equals_scoring_a_table(spark, tmp_path):
    from modelkeel.streaming.common import drain_to_table, file_stream

    frame = Toy().ingest(spark, "colour", rows=120)
    model = Toy().build_model("colour", 120).fit(frame)
    frame.select("text", "size", "colour").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, max_files=1)
    labels = tr.class_labels(model)
    wanted = ["text", "size", "prediction", "confidence", "model_version"]
    got = drain_to_table(tr.score(model, stream, version="4", labels=labels).select(*wanted), "score")
    want = tr.score(model, frame, version="4", labels=labels).select(*wanted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
