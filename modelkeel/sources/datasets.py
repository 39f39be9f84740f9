"""Columnar data sets, JSON documents, step results and files by modification time."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeel.schema import columns


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_dataset(df: DataFrame, path: str) -> str:
    """Land a data set in a run folder. Run folders are immutable, so a rerun must rename."""
    df.write.mode("errorifexists").parquet(path)
    return path


def files_since(spark: SparkSession, path: str, since: Column, *, glob: str = "*") -> DataFrame:
    """Files below ``path`` modified at or after ``since`` (inclusive), without their content.

    Only the hidden metadata column is read; ``modifiedAfter`` is not used because
    its bound is exclusive.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return listing.select(
        F.col("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")
    ).filter(F.col("modified") >= since)


FILE_TIME = "_metadata.file_modification_time"


def read_rows_since(df: DataFrame, since: Column) -> DataFrame:
    """Keep the rows whose file was modified at or after ``since`` (inclusive); ``df`` is a file scan.

    The condition is on a value that is the same for a whole file, so the scan drops files by it before it opens them.
    """
    return df.filter(F.col(FILE_TIME) >= since)


def rows_by_file(df: DataFrame, since: Column | None = None) -> DataFrame:
    """``file, modified, n``: rows of every file of a scan, of those modified at or after ``since`` if it is given.

    A file without rows has no row here.
    """
    scanned = df if since is None else read_rows_since(df, since)
    named = scanned.select(F.col("_metadata.file_path").alias("file"), F.col(FILE_TIME).alias("modified"))
    return named.groupBy("file", "modified").agg(F.count(F.lit(1)).alias("n"))


def newest_file_time(df: DataFrame) -> datetime | None:
    """Modification time of the newest file of a scan that has rows; the mark a later reading starts behind."""
    return df.agg(F.max(FILE_TIME)).first()[0]


def oldest_file_time(df: DataFrame) -> datetime | None:
    return df.agg(F.min(FILE_TIME)).first()[0]


def write_json_document(spark: SparkSession, path: str, document: Mapping) -> None:
    text = json.dumps(document, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


RESULTS = columns(run_id="string", step="string", result_json="string")


def append_step_result(spark: SparkSession, path: str, run_id: str, step: str, result: Mapping) -> None:
    """One row per finished step; the document keeps nested values, scalars are derived later."""
    row = [(run_id, step, json.dumps(result, default=str))]
    spark.createDataFrame(row, RESULTS).coalesce(1).write.mode("append").parquet(path)


def scalar_entries(results: DataFrame) -> DataFrame:
    """One row per scalar entry of every result document; lists and objects are left out.

    Booleans come out lower-case because JSON spells them that way.
    """
    raw = F.from_json("result_json", "map<string,string>")
    typed = results.select("run_id", "step", F.explode(raw).alias("name", "value"))
    nested = F.coalesce(F.col("value").rlike(r"^\s*[\[{]"), F.lit(True))
    return typed.filter(~nested)
