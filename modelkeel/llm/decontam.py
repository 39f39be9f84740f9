"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity.

For every benchmark item of ``m`` words, windows of ``m`` words of a document are fingerprinted: each five-word
shingle votes on 64 bits. Fingerprints are looked up in a multi-index: 64 bits in five blocks, and two fingerprints
within ``RADIUS`` = 19 bits agree up to 3 bits in at least one block, so every block value is listed with all its
neighbours of up to 3 bits, and no fingerprint within the radius is missed. What is found within the radius is
decided by the weighted Jaccard similarity of the two multisets of shingles.

Only windows that hold a shingle of the benchmark are fingerprinted, which loses nothing: a window without one has
similarity 0. A document shorter than an item is one window for it, found by its rarest shingles and decided by the
same similarity. At similarity 0.8 two fingerprints differ in 9.7 bits on average (standard deviation 2.9).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeel.llm.hashing import mix, shingle_hashes, slices, text_bytes, word_bounds, word_hashes

SHINGLE = 5
RADIUS = 19
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
NEAR_BITS = RADIUS // len(BLOCKS)
#: Items and words of the benchmark held by a worker at once; a larger benchmark is taken in blocks.
ITEMS_AT_ONCE, WORDS_AT_ONCE = 2000, 1 << 20
_PIECE, _SPAN = 4 << 20, 4096
_FILTER_BITS = 22


def fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles."""
    votes = np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(votes, axis=0)))
    bits = (total[size:] - total[:-size]) > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _neighbours(width: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for n in range(NEAR_BITS + 1) for bits in combinations(range(width), n)], np.uint64)


def _block_keys(prints: np.ndarray, size: np.ndarray | int, block: int) -> np.ndarray:
    low, width = BLOCKS[block]
    value = (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
    return (np.asarray(size, np.uint64) << np.uint64(20)) | np.uint64(block << 13) | value


@dataclass
class Index:
    """A block of the benchmark: items, their shingles, and the multi-index of their fingerprints."""

    ids: list[int]
    shingles: list[np.ndarray]
    prints: np.ndarray
    known: np.ndarray
    passes: np.ndarray
    keys: np.ndarray
    owners: np.ndarray
    short: dict[int, dict[int, list[int]]]
    sizes: np.ndarray
    holders: np.ndarray
    holders_from: np.ndarray


def build(items: list[tuple[int, str | None]]) -> Index:
    """Index of (item_id, text) rows; items without words are left out."""
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
    starts, ends, rows = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    counts = np.bincount(rows, minlength=len(items)) if len(items) else np.empty(0, int)
    value, owner = shingle_hashes(words, rows, len(items), SHINGLE)
    ids, shingles, prints, short = [], [], [], {}
    for k, (item, _) in enumerate(items):
        own = value[owner == k]
        if not counts[k]:
            continue
        if counts[k] < SHINGLE:
            short.setdefault(int(counts[k]), {}).setdefault(int(own[0]), []).append(item)
            continue
        ids.append(item)
        shingles.append(own)
        prints.append(fingerprints(own, len(own))[0])
    prints = np.array(prints, np.uint64)
    sizes = np.array([len(s) for s in shingles], np.uint64)
    keys, owners = [], []
    for block, (_, width) in enumerate(BLOCKS):
        near = _block_keys(prints, sizes, block)[:, None] ^ _neighbours(width)[None, :]
        keys.append(near.ravel())
        owners.append(np.repeat(np.arange(len(ids), dtype=np.int32), near.shape[1]))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys, kind="stable")
    known = np.unique(np.concatenate([*shingles, np.empty(0, np.uint64)]))
    passes = np.zeros(1 << _FILTER_BITS, bool)
    passes[(known & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    own = [np.unique(x) for x in shingles]
    held, holder = np.concatenate([*own, np.empty(0, np.uint64)]), np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
    by = np.argsort(held, kind="stable")
    holders_from = np.append(np.searchsorted(held[by], known), len(held))
    return Index(ids, shingles, prints, known, passes, keys[order], owners[order], short, sizes.astype(np.int64), holder[by], holders_from)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both)


def _search(shingles: np.ndarray, hits: np.ndarray, index: Index, least: float, found: dict[int, tuple[float, int]]) -> None:
    """Windows of one document around its hits; ``found``: best similarity and number of windows of an item."""
    for size in np.unique([len(s) for s in index.shingles]).tolist():
        if size > len(shingles):
            continue
        starts = np.unique(np.clip(hits[:, None] - np.arange(size)[None, :], 0, len(shingles) - size).ravel()) if len(hits) * size < 1 << 22 else np.arange(len(shingles) - size + 1)
        cuts = np.flatnonzero(np.diff(starts) > size) + 1
        for run in np.split(starts, cuts):
            for k in range(0, len(run), _SPAN):
                some = run[k : k + _SPAN]
                low = int(some[0])
                prints = fingerprints(shingles[low : int(some[-1]) + size], size)[some - low]
                _look_up(shingles, some, prints, size, index, least, found)


def _search_longer(shingles: np.ndarray, hits: np.ndarray, index: Index, least: float, found: dict[int, tuple[float, int]]) -> None:
    """Items longer than the document, which is then one window as a whole; no pair is missed.

    Of ``n`` shingles and an item of more, at least ``least * (2 * n + 1) / (1 + least)`` are common. So one of any
    ``n - needed + 1`` shingles of the document is in the item; the ones that the fewest items hold are taken.
    """
    n = len(shingles)
    needed = int(np.ceil(least * (2 * n + 1) / (1 + least) - 1e-9))
    if len(hits) < needed or not ((index.sizes > n) & (index.sizes * least <= n + 1e-9)).any():
        return
    at = np.searchsorted(index.known, shingles[hits])
    times = index.holders_from[at + 1] - index.holders_from[at]
    # the shingles that no item holds come first
    rarest = np.unique(at[np.argsort(times, kind="stable")[: len(hits) - needed + 1]])
    items = np.unique(np.concatenate([index.holders[index.holders_from[k] : index.holders_from[k + 1]] for k in rarest]))
    for item in items[(index.sizes[items] > n) & (index.sizes[items] * least <= n + 1e-9)].tolist():
        alike = similarity(shingles, index.shingles[item])
        if alike >= least:
            best, windows = found.get(index.ids[item], (0.0, 0))
            found[index.ids[item]] = max(best, alike), windows + 1


def _look_up(shingles, starts, prints, size, index, least, found) -> None:
    pairs = []
    for block in range(len(BLOCKS)):
        keys = _block_keys(prints, size, block)
        low, high = np.searchsorted(index.keys, keys, "left"), np.searchsorted(index.keys, keys, "right")
        n = high - low
        where = np.repeat(np.arange(len(keys)), n)
        item = index.owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        pairs.append(where.astype(np.int64) * len(index.ids) + item)
    for pair in np.unique(np.concatenate(pairs)).tolist():
        at, item = divmod(pair, len(index.ids))
        if int(prints[at] ^ index.prints[item]).bit_count() > RADIUS:
            continue
        alike = similarity(shingles[starts[at] : starts[at] + size], index.shingles[item])
        if alike >= least:
            best, n = found.get(index.ids[item], (0.0, 0))
            found[index.ids[item]] = max(best, alike), n + 1


def leaks(column: pa.Array, index: Index, least: float) -> Iterator[dict[int, tuple[float, int]]]:
    """For every text of a column, the items it holds: best similarity and number of windows."""
    data, offsets = text_bytes(column)
    low_bits = np.uint64((1 << _FILTER_BITS) - 1)
    for low, high in slices(offsets, _PIECE):
        part, cuts = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, rows = word_bounds(part, cuts)
        words = word_hashes(part, starts, ends)
        found: list[dict] = [{} for _ in range(high - low)]
        value, owner = shingle_hashes(words, rows, high - low, SHINGLE)
        maybe = np.flatnonzero(index.passes[(value & low_bits).astype(np.int64)])
        hits = maybe[np.isin(value[maybe], index.known)]
        for row in np.unique(owner[hits]).tolist():
            first, last = np.searchsorted(owner, [row, row + 1])
            own = hits[owner[hits] == row] - first
            _search(value[first:last], own, index, least, found[row])
            _search_longer(value[first:last], own, index, least, found[row])
        for size, items in index.short.items():
            value, owner = shingle_hashes(words, rows, high - low, size)
            for place in np.flatnonzero(np.isin(value, np.array(list(items), np.uint64))).tolist():
                for item in items[int(value[place])]:
                    best, n = found[owner[place]].get(item, (0.0, 0))
                    found[owner[place]][item] = 1.0, n + 1
        yield from found


def item_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark as indexes of bounded size, read item by item."""
    held, words = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len((row["text"] or "").split())
        if held and (len(held) >= ITEMS_AT_ONCE or words + n > WORDS_AT_ONCE):
            yield build(held)
            held, words = [], 0
        held.append((row["item_id"], row["text"]))
        words += n
    yield build(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """``doc_id, item_id, similarity, n_windows`` of every item that a document holds, all texts whole.

    Words are lower-cased (A-Z). An item of fewer than five words is one shingle, its whole sequence, and must
    occur as it is; items and texts that are null or have no words match nothing. A document shorter than the item
    is compared with it as a whole, which counts as one window. Repeated rows of ``docs`` give a row each, repeated item_ids one row of the best; an empty table
    on either side gives no row. Other columns are not read.
    """
    spark, out = docs.sparkSession, None
    for index in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column("doc_id"), []
                for k, found in enumerate(leaks(batch.column("text"), shared.value, least)):
                    rows += [{"doc_id": ids[k].as_py(), "item_id": i, "similarity": s, "n_windows": n} for i, (s, n) in found.items()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("n_windows", pa.int64())]))

        part = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, item_id long, similarity double, n_windows long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no benchmark item.

    Each row is judged by its whole text, so repeated rows stay or go together; null and word-less texts hold nothing and
    stay, as does everything if the benchmark is empty; a similarity of exactly ``least`` is a find.
    """
    spark, place = docs.sparkSession, docs.columns.index("text")
    for index in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in leaks(batch.column(place), shared.value, least)], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
