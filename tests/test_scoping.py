"""One definition of text weights; the monitor's own records; gates of both kinds of targets."""

from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.ml import Pipeline

from modelkeel import load_use_case
from modelkeel.operators.features import tfidf_weights
from modelkeel.plans import monitor
from modelkeel.plans import training as tr
from modelkeel.sources.metric_text import parse_samples


def test_pipeline_weights_are_the_operators(spark):
    rows = [(0, "red apple red pie"), (1, "red sky at night"), (2, "apple pie at night red"), (3, "lonely word")]
    docs = spark.createDataFrame(rows, "id long, t string")
    vectors = Pipeline(stages=tr.text_stages("t", "v", 1 << 18)).fit(docs).transform(docs).collect()
    weights = {}
    for r in tfidf_weights(docs, "id", "t").collect():
        weights.setdefault(r["id"], []).append(r["weight"])
    for r in vectors:
        mine = sorted(x for x in r["v"].values if x)
        assert mine == pytest.approx(sorted(weights.get(r["id"], [])), abs=1e-9)
    assert 3 not in weights


def test_monitor_takes_its_use_case_and_days_only(spark):
    run = SimpleNamespace(model="m", use_case=SimpleNamespace(name="a"))
    rows = [("a", "m", "2024-01-02", 1), ("b", "m", "2024-01-02", 2), ("a", "n", "2024-01-02", 3), ("a", "m", "2024-01-01", 4), ("a", "m", "2023-12-30", 5)]
    log = spark.createDataFrame(rows, "use_case string, model string, date string, id int")
    own = monitor._own_records(run, log, datetime(2024, 1, 2, 0, 10), 30)
    assert sorted(r["id"] for r in own.collect()) == [1, 4]
    assert monitor._own_records(run, log.drop("use_case", "date"), datetime(2024, 1, 2), 30).count() == 4


def test_samples_with_stamps_and_escapes(spark):
    lines = [('a_total{x="1",y="q\\"b\\\\c\\nd"} 5 1700000000000',), ("b 2.5",), ("# HELP b x",), ("c{} NaN",)]
    got = {r["name"]: r for r in parse_samples(spark.createDataFrame(lines, "line string")).collect()}
    assert set(got) == {"a_total", "b", "c"}
    assert got["a_total"]["value"] == 5.0 and got["a_total"]["labels"] == {"x": "1", "y": 'q"b\\c\nd'}


def test_what_a_use_case_lacks_is_named():
    with pytest.raises(TypeError, match="models, ingest"):
        load_use_case("math:pi")
