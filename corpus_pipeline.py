"""A training corpus out of raw documents: the stages in their order, and the whole run.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again
as the next one's documents. All stages but the last return the columns of documents; the last returns the mix: how
often, and with how many words, each document that is left is taken, and the texts that this gives.

No stage drops a row for a null in some column: a null or empty text is judged as a text without words, null ids are
rows like others, repeated rows are rows of their own (equal lines and near copies among them go as their stage
says), texts are read whole, and columns beyond those of documents are carried along up to the mix. Of lines and near
copies that of the smallest doc_id stays, then that of the smallest hash of the text. An empty table of documents
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeel.llm import bottomk, decontam, linededup, mixing, nbsvm
from modelkeel.session import fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, takes for good."""
    return nbsvm.keep_good(docs, nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line resembles; n_chars follows the text."""
    kept = linededup.remove_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of at least 0.8."""
    return bottomk.keep_one(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their target weights: the plan of each document, and its texts, none if it is left out."""
    return mixing.take(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: The classifier has no SQL; the run is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
