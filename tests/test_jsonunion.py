"""JSON lines without a declared schema, against Python's reading of them."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeel.sources.jsonunion import CORRUPT, merged_schema, parsed_lines, read_json_union, variant_text
from modelkeel.sources import datasets

LINES = [
    '{"id": 1, "x": 1, "mixed": 5, "s": "a"}',
    "", "   ",
    '{"id": 2, "x": 2.5, "mixed": "five", "deep": {"a": 1, "b c": [1, 2]}}',
    '{"id": 3, "mixed": {"y": [1, null]}, "deep": {"a": 7, "z": true}, "S": "other case"}',
    '{"id": 4, "mixed": null, "gone": null, "big": 123456789012345678901, "we`ird.key": "OBJECT<x>", "": 1}',
    '{"id": 5, "mixed": 1.5, "s": null, "list": []}',
    '{"id": 6, "list": ["p"], "quote\'s": 2}',
    "{}",
]


def write(tmp_path, name, lines):
    folder = tmp_path / name
    folder.mkdir()
    for i in range(0, len(lines), 3):
        (folder / f"part-{i}.jsonl").write_text("\n".join(lines[i : i + 3]))
    return str(folder)


def test_every_key_is_a_column(spark, tmp_path):
    rows = read_json_union(spark, write(tmp_path, "a", LINES))
    objects = [json.loads(x) for x in LINES if x.strip()]
    assert set(rows.columns) == {k for o in objects for k in o}
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    assert kinds["id"] == T.LongType() and kinds["x"] == T.DoubleType() and kinds["s"] == T.StringType() and kinds["gone"] == T.StringType()
    assert isinstance(kinds["mixed"], T.VariantType) and isinstance(kinds["big"], T.DecimalType)
    got = {r["id"]: r for r in rows.withColumn("mixed", variant_text("mixed")).collect()}
    assert len(got) == len(objects)
    for o in objects:
        row = got[o.get("id")]
        for k in ("x", "s", "S", "we`ird.key", "", "quote's", "list"):
            assert row[k] == o.get(k)
        want = o.get("mixed")
        assert row["mixed"] == (want if isinstance(want, str) or want is None else json.dumps(want, separators=(",", ":")))
    assert got[2]["deep"].asDict() == {"a": 1, "b c": [1, 2], "z": None} and got[4]["big"] == 123456789012345678901


def test_lines_that_are_no_object_are_kept(spark, tmp_path):
    path = write(tmp_path, "b", ['{"id": 1}', "not json", "[1]", "7", '{"id": 2}'])
    rows = read_json_union(spark, path).collect()
    assert sorted((r["id"], r[CORRUPT]) for r in rows if r["id"]) == [(1, None), (2, None)]
    assert sorted(r[CORRUPT] for r in rows if not r["id"]) == ["7", "[1]", "not json"]


def test_no_object(spark, tmp_path):
    assert read_json_union(spark, write(tmp_path, "c", ["", "{}"])).columns == []
    assert merged_schema(parsed_lines(spark, write(tmp_path, "d", [""]))).fields == []


def test_schema_job_keeps_the_lines_apart(spark, tmp_path):
    """The columns come from the landed values: the text is parsed in one scan only."""
    plan = read_json_union(spark, write(tmp_path, "e", LINES))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "parquet" in plan.lower()


def test_files_are_chosen_by_their_time(spark, tmp_path):
    path = f"{tmp_path}/landed"
    spark.range(10).coalesce(1).write.parquet(path)
    mark = datasets.newest_file_time(spark.read.parquet(path))
    spark.range(100, 130).write.mode("append").parquet(path)
    landed = spark.read.parquet(path)
    assert datasets.read_rows_since(landed, F.lit(mark)).count() == 40  # the bound is inclusive
    later = datasets.rows_by_file(landed, F.lit(datasets.newest_file_time(landed)))
    assert later.agg(F.sum("n")).first()[0] <= 30
    assert datasets.rows_by_file(landed).agg(F.sum("n")).first()[0] == 40
