"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's sketch is the ``SKETCH`` smallest hashes of its set of five-word shingles. Inverted lists of the
sketch values give candidates, the sketch of the union estimates their similarity, and whole sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelkeel.llm.components import components
from modelkeel.llm.hashing import WORD, shingle_hashes, slices, text_bytes, word_bounds, word_hashes
from modelkeel.session import materialise

SKETCH = 48
_PIECE = 4 << 20


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column, in order."""
    data, offsets = text_bytes(column)
    for low, high in slices(offsets, _PIECE):
        part, cuts = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, rows = word_bounds(part, cuts)
        value, owner = shingle_hashes(word_hashes(part, starts, ends), rows, high - low, size)
        bounds = np.searchsorted(owner, np.arange(high - low + 1))
        for k in range(high - low):
            yield np.unique(value[bounds[k] : bounds[k + 1]])


def _key(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


_ROWS = "uid long, doc_id long, th long, n long, key binary, sketch array<long>"
_ROWS_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        n, keys, sketches = [], [], []
        for values in shingle_sets(batch.column("text")):
            n.append(len(values))
            keys.append(_key(values))
            sketches.append(values[:SKETCH].view(np.int64))
        flat = np.concatenate([*sketches, np.empty(0, np.int64)])
        cuts = np.concatenate(([0], np.cumsum([len(s) for s in sketches]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(uid, uid + batch.num_rows)), batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
            pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], schema=_ROWS_ARROW)
        uid += batch.num_rows


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, size = [], 0
        for values in shingle_sets(batch.column("text")):
            held.append({"key": _key(values), "whole": values.tobytes()})
            size += values.nbytes
            if size > _PIECE:
                yield pa.RecordBatch.from_pylist(held, pa.schema([("key", pa.binary()), ("whole", pa.binary())]))
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, pa.schema([("key", pa.binary()), ("whole", pa.binary())]))


def needed(k, least: float):
    """Values that two sketches of ``k`` have in common at least, if the sets are alike to ``least``.

    The union's sketch holds ``least * k`` common values on average, all of them in both sketches; five and a
    half standard deviations are allowed below that.
    """
    return np.maximum(np.ceil(least * k - 5.5 * np.sqrt(k * least * (1 - least))), 1)


def _estimate(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            xs, ys = batch.column("sketch_a"), batch.column("sketch_b")
            for i in range(batch.num_rows):
                x, y = (np.asarray(s[i].values).view(np.uint64) for s in (xs, ys))
                both = np.concatenate((x, y))
                both.sort()
                twice = both[:-1][both[1:] == both[:-1]]
                union = np.unique(both)[: max(len(x), len(y))]
                keep.append(len(union) > 0 and (np.searchsorted(twice, union[-1], "right") >= needed(len(union), least)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def _confirm(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            xs, ys = batch.column("whole_a"), batch.column("whole_b")
            for i in range(batch.num_rows):
                x, y = np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def _beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of both nodes."""
    for side in ("b", "a"):
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def _sets(docs: DataFrame, nodes: DataFrame, some: DataFrame) -> DataFrame:
    """``node, whole``: the whole sets of some nodes, taken once more from the texts."""
    wanted = materialise(nodes.select("node", "key", "first_id").join(some, "node"), "near-nodes")
    ids = wanted.select(F.col("first_id").alias("of")).distinct()
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").select("text")
    sets = texts.mapInArrow(_whole, "key binary, whole binary").join(wanted.select("node", "key"), "key")
    return materialise(sets.groupBy("node").agg(F.first("whole").alias("whole")), "near-sets")


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """Those pairs of nodes whose whole sets are alike enough."""
    near = materialise(_beside(pairs, nodes, "sketch").mapInArrow(_estimate(percent / 100), "a long, b long"), "near-pairs")
    if sets is None:
        sets = _sets(docs, nodes, near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct())
    return materialise(_beside(near, sets, "whole").mapInArrow(_confirm(percent), "a long, b long"), "links")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            values = np.frombuffer(batch.column("whole")[k].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(len(values), batch.column("node")[k].as_py(), np.int64))], ["value", "node"])


def _prefixes(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``value, node, root, n, pos``: the first shingles of whole sets in order of rarity, where alike sets must meet.

    A shingle that one set alone has meets nothing, but counts in the places of the others.
    """
    values = sets.mapInArrow(_spread, "value long, node long")
    times = materialise(values.groupBy("value").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "shared-shingles")
    shared = values.join(times, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("shared"))
    n, rest = F.col("n"), F.col("n") - F.size("shared")
    prefix = n - F.ceil(n * percent / F.lit(100)) + 1
    ranked = shared.join(sizes, "node").where(rest < prefix)
    places = ranked.select("node", "root", "n", rest.alias("rest"), F.posexplode(F.slice("shared", F.lit(1), (prefix - rest).cast("int"))).alias("k", "s"))
    return places.select(F.col("s.value").alias("value"), "node", "root", "n", (F.col("rest") + F.col("k")).alias("pos"))


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, th, n, root, component_id`` of every row of ``docs``: the hash of its text, the size of its set, its component.

    Rows with equal sets are one node from the start. Of each node's sketch only the rarest values are looked up:
    two alike sets share so many sketch values (:func:`needed`) that they share one of these. A list's nodes are
    first compared with one of them, the one with the fewest values of its own; the nodes that this joins need no
    comparison any more. What then still stands apart in a list is compared across components, where the whole sets
    meet in one of their rarest shingles at a place that leaves enough to share. So large groups of copies cost one
    comparison a copy and list, while no pair that could link two components is left out.

    Null and word-less texts have no set and stand alone. Rows of one doc_id are rows of their own; if that id is
    the smallest, all of them are kept. A null doc_id is never the smallest, unless a component has nothing else.
    An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    rows = materialise(docs.mapInArrow(_sketch, _ROWS), "sketches")
    nodes = materialise(rows.where("n > 0").groupBy("key").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")

    values = nodes.select("node", F.explode("sketch").alias("value"))
    shared = materialise(values.groupBy("value").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "shared-values")
    k, s = F.least(F.col("n"), F.lit(SKETCH)), percent / 100
    least = F.greatest(F.ceil(s * k - 5.5 * F.sqrt(k * s * (1 - s))), F.lit(1))
    known = values.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("rare"))
    ranked = known.join(nodes.select("node", (k - least + 1).alias("prefix"), k.alias("k")), "node")
    own = F.col("k") - F.size("rare")
    looked = ranked.where(own < F.col("prefix")).select("node", own.alias("own"), F.explode(F.slice("rare", F.lit(1), (F.col("prefix") - own).cast("int"))).alias("r"))
    lists = materialise(looked.select("node", "own", F.col("r.value").alias("value")), "lists")

    leaders = materialise(lists.groupBy("value").agg(F.min(F.struct("own", "node")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
                          .select("value", F.col("m.node").alias("a")), "leaders")
    stars = materialise(lists.join(leaders, "value").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "stars")
    links = _links(docs, nodes, stars, percent)
    joined = materialise(components(links), "joined")

    placed = lists.join(joined, "node", "left").select("value", "node", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("value")
    open_lists = materialise(placed.join(materialise(split, "open"), "value"), "open-lists")
    sets = _sets(docs, nodes, open_lists.select("node").distinct())
    roots_of = open_lists.select("node", "root").distinct().join(nodes.select("node", "n"), "node")
    entries = materialise(_prefixes(sets, roots_of, percent), "prefixes")
    x, y = entries.alias("x"), entries.alias("y")
    apart = (F.col("x.value") == F.col("y.value")) & (F.col("x.root") < F.col("y.root"))
    common = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    enough = common * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    across = x.join(y, apart & enough).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    across = materialise(across.join(stars, ["a", "b"], "left_anti").join(stars.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "across")
    roots = nodes.select("key", "node", "first_id").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if across.count():
        # links between components join their roots
        more, of = _links(docs, nodes, across, percent, sets), joined.select(F.col("node").alias("n"), "root")
        for side in ("a", "b"):
            more = more.join(of, F.col(side) == F.col("n"), "left").withColumn(side, F.coalesce("root", side)).drop("n", "root")
        again = materialise(components(more).select(F.col("node").alias("r"), F.col("root").alias("top")), "components")
        roots = roots.join(again, F.col("root") == F.col("r"), "left").withColumn("root", F.coalesce("top", "root"))
    ids = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(roots.join(ids, "root").select("key", "root", "component_id"), "named")
    found = rows.select("doc_id", "th", "n", "key").join(named, "key", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "th", "n", "root", component.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``; see :func:`groups`."""
    component = F.col("component_id")
    return groups(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), component, component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all their columns: of each component one, with the smallest doc_id, and all without a set.

    Of rows of that doc_id the one with the smallest hash of its text stays, of rows equal in both any one.
    """
    found = materialise(groups(docs, percent), "groups")
    first = found.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th")).alias("f")).select("f.doc_id", "f.th")
    keys = [F.xxhash64("doc_id", "th").alias("k1"), F.xxhash64("th", "doc_id").alias("k2")]
    winners = materialise(first.select(*keys).distinct(), "winners").withColumnsRenamed({"k1": "w1", "k2": "w2"})
    place = F.row_number().over(Window.partitionBy("_d.k1", "_d.k2").orderBy("_d.k1"))
    row = docs.select(F.struct(F.xxhash64("doc_id", F.xxhash64("text")).alias("k1"), F.xxhash64(F.xxhash64("text"), "doc_id").alias("k2"),
                               F.struct(*docs.columns).alias("row")).alias("_d"))
    words = F.col("_d.row.text").rlike(WORD)
    without = row.where(~F.coalesce(words, F.lit(False))).select("_d.row.*")
    one = row.join(winners, (F.col("_d.k1") == F.col("w1")) & (F.col("_d.k2") == F.col("w2")), "left_semi")
    one = one.withColumn("place", place).where("place = 1").select("_d.row.*")
    return one.unionByName(without)


def op8_bottom_k(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
