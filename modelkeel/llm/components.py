"""Connected components by alternating large-star and small-star rounds over written edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeel.session import materialise

#: Edges up to which one task joins them at once: for so few, the jobs of the rounds cost more than their rows.
FEW_EDGES = 1 << 14


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of every node that are larger (or not larger) than it to its smallest neighbour; a < b in and out."""
    around = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if larger:
        around = around.union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    lowest = around.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("c"), F.least("u", "low").alias("low"))
    joined = around.join(lowest, F.col("u") == F.col("c"))
    if larger:
        return joined.where("v > u").select(F.col("low").alias("a"), F.col("v").alias("b")).distinct()
    to_low = joined.where("v <> low").select(F.col("low").alias("a"), F.col("v").alias("b"))
    return to_low.union(lowest.select(F.col("low").alias("a"), F.col("c").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge (a, b) hangs a node b, which has no other edge, on a node a that hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("hangs")).union(edges.select(F.col("b").alias("node"), F.lit(1).alias("hangs")))
    seen = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least"))
    return seen.where("hangs > 1 OR (hangs = 1 AND least = 0)").count() == 0


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and root of every node of at most ``FEW_EDGES`` edges."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in "ab")):
            low, high = sorted((root(a), root(b)))
            up[high] = low
        kind = batch.schema.field("a").type
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in list(up)], kind)], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (a, b): the smallest node it is linked to, however far.

    The rounds end when every node hangs on its component's smallest node. Each round is written to the shared
    folder, so a lost executor costs at most its tasks. Loops and repeated edges are fine; null ends are dropped;
    no edge gives no row. A graph of at most ``FEW_EDGES`` edges needs no rounds.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= FEW_EDGES:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_at_once, f"node {kind}, root {kind}")
    while not _are_stars(edges):
        # one table a round: what a step uses twice is behind a shuffle, which Spark reuses
        edges = materialise(_stars(_stars(edges, larger=True), larger=False), "edges")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
