"""Quality classifier: Naive Bayes support vectors over byte n-grams.

A text becomes the indicators of its hashed byte n-grams, each scaled by the log ratio of its smoothed shares in
the two classes, the whole at unit length. A linear hinge-loss model over these is fitted by dual coordinate
descent; a logistic curve over its margin gives the score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeel.llm.hashing import text_bytes, word_bounds, word_hashes

BITS = 18
SIZES = (1, 2, 3, 4)
#: Labelled rows the model is fitted on at most, the first by the md5 of their id.
MAX_TRAINING_ROWS = 8000
_PIECE = 1 << 21


def mark_repeats(data: np.ndarray) -> np.ndarray:
    """The text with each word that equals the one before it written as one byte 1, so n-grams see repetition."""
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    if len(starts) < 2:
        return data
    words = word_hashes(data, starts, ends)
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    if not len(again):
        return data
    out = data.copy()
    out[starts[again]] = 1
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, starts[again] + 1, 1)
    np.add.at(inside, ends[again], -1)
    return out[np.cumsum(inside)[:-1] == 0]


def slots(data: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The distinct n-gram slots of one text; ``mark`` is a cleared scratch array of all slots."""
    data = mark_repeats(data)
    for low in range(0, len(data), _PIECE):
        code, part = np.zeros(min(_PIECE, len(data) - low), np.uint64), data[low : low + _PIECE + max(SIZES)]
        for n in range(1, max(SIZES) + 1):
            m = min(len(code), len(part) - n + 1)
            if m <= 0:
                break
            code = code[:m] | (part[n - 1 : n - 1 + m].astype(np.uint64) << np.uint64(8 * (n - 1)))
            if n in SIZES:
                mark[(((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        scale = self.ratio[found]
        size = float(np.sqrt(scale @ scale))
        return float(self.weight[:-1][found] @ scale) / size + self.weight[-1] if size else float(self.weight[-1])

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def fit(flat: np.ndarray, cuts: np.ndarray, labels: np.ndarray, cost: float = 1.0, epochs: int = 30, smooth: float = 1.0, seed: int = 5) -> Model:
    """Fit on the slots of texts (``flat``, a text's from one cut to the next) and their 0/1 labels. With one class only, every score is that class's smoothed share."""
    n_slots, y = 1 << BITS, np.where(labels == 1, 1.0, -1.0)
    counts = {s: np.full(n_slots, smooth) for s in (1.0, -1.0)}
    for i, s in enumerate(y):
        counts[s][flat[cuts[i] : cuts[i + 1]]] += 1
    ratio = np.log((counts[1.0] / counts[1.0].sum()) / (counts[-1.0] / counts[-1.0].sum()))
    if len(set(y.tolist())) < 2:
        share = ((labels == 1).sum() + 1) / (len(labels) + 2)
        return Model(ratio * 0, np.zeros(n_slots + 1), 1.0, float(np.log(share / (1 - share))))
    weight, alpha, rng = np.zeros(n_slots + 1), np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            found = flat[cuts[i] : cuts[i + 1]]
            value = ratio[found]
            value /= np.sqrt(value @ value) or 1.0
            square = 1.0 + (1.0 if len(found) else 0.0)
            step = 1 - y[i] * (weight[:-1][found] @ value + weight[-1])
            new = min(max(alpha[i] + step / square, 0.0), cost)
            if new != alpha[i]:
                weight[found] += (new - alpha[i]) * y[i] * value
                weight[-1] += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return Model(ratio.astype(np.float32), weight.astype(np.float32), 3.0, 0.0)


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out third, whole texts.

    Labels other than 0 and 1 are left out; an id labelled twice counts with its lower label; ids that repeat
    among the documents all count.
    """
    known = labels.where("quality IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    picked = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(picked), F.col("d") == F.col("doc_id")).select("d", "text", "label")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, bool)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for k in range(batch.num_rows):
                found = slots(data[offsets[k] : offsets[k + 1]], mark).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column("d").slice(k, 1), pa.array([hashlib.md5(found).hexdigest()]), batch.column("label").slice(k, 1).cast(pa.int32()), pa.array([found])],
                    ["d", "digest", "label", "slots"])

    got = texts.mapInArrow(cut, "d long, digest string, label int, slots binary").toArrow().sort_by([("d", "ascending"), ("digest", "ascending")])
    sizes = pa.compute.binary_length(got["slots"]).to_numpy() // 4
    flat = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in got["slots"]] + [np.empty(0, np.int32)])
    return fit(flat, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), got["label"].to_numpy())


def _scores(column: pa.Array, model: Model, mark: np.ndarray) -> np.ndarray:
    data, offsets = text_bytes(column)
    return np.array([model.score(slots(data[offsets[k] : offsets[k + 1]], mark)) for k in range(len(column))], np.float64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text; a null text counts as empty.

    Every row is scored by itself: repeated rows, null ids and extra columns change nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, bool)
        for batch in batches:
            found = _scores(batch.column("text"), shared.value, mark)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all their columns, that the model takes for good.

    Each row is judged by its whole text, so rows of equal texts stay or go together, whatever their ids; a null text is
    judged as an empty one and stays null; a score of exactly 0.5 stays; an empty table stays empty.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, bool)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), shared.value, mark) >= 0.5))

    return docs.mapInArrow(work, docs.schema)


def op7_quality_nbsvm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
