"""Removal of repeated byte strings by suffix order: a column-wise Burrows-Wheeler construction over many documents.

A string of ``LENGTH`` bytes that starts twice has the same smallest hash of its ``GRAM``-byte strings at both places.
So the starts of every document are cut into runs of equal smallest hash, the run's key, and two starts of equal
strings are in runs of one key. A run's segment is the text its strings cover. Keys with one run repeat nothing;
where all segments of a key are equal, all of it repeats. Only the segments of the other keys are sorted:
their collection's Burrows-Wheeler transform grows by one symbol of every segment each round, from the last to
the first, and the suffixes that begin with equal strings are neighbours in the finished order.

The collections are whole keys of about ``BUCKET`` bytes together, dealt out by a shuffle, so each is built in memory
in one sequential pass a round. A key of more than ``MOST`` segments is not sorted: its strings are counted by hash, in blocks of strings that
are halved only where some of them may repeat and others not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeel.llm.hashing import _VALUE, _powers, mix, text_bytes
from modelkeel.session import materialise

LENGTH, GRAM = 200, 64
BUCKET, MOST = 1 << 17, 500
#: Neighbouring strings in a block, from the first count to the last.
BLOCKS = (64, 16, 4, 1)
#: Bits of the bounded filter that keeps segments of keys with one kind of segment from being read again.
FILTER_BITS = 1 << 24
_PIECE = 1 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if have < width else out


def runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Runs of starts of the texts: row, start in the row, number of starts, key, hash of the segment, place in ``data``."""
    up, down = _powers(2 * _PIECE)
    n = len(data)
    for low in range(0, max(n - LENGTH + 1, 0), _PIECE):
        part = data[low : low + _PIECE + LENGTH - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[: len(part)], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * down[: len(part) - GRAM + 1])
        least = _sliding_min(grams, LENGTH - GRAM + 1)
        starts = np.arange(low, low + len(least))
        rows = np.searchsorted(offsets, starts, "right") - 1
        inside = starts + LENGTH <= offsets[rows + 1]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(new & inside)
        after = np.flatnonzero(np.append((new | ~inside)[1:], True)) + 1
        stop = after[np.searchsorted(after, first, "right")]
        size = (stop - first + LENGTH - 1).astype(np.uint64)
        segment = mix((total[stop + LENGTH - 1] - total[first]) * down[first] + size * np.uint64(0x51ED270B))
        yield {"row": rows[first], "start": first + low - offsets[rows[first]], "n": stop - first, "key": least[first].view(np.int64),
               "segment": segment.view(np.int64), "at": first + low}


_RUNS = "key long, segment long, doc_id long, th long, start long, n long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in runs(*text_bytes(batch.column("text"))):
            yield pa.RecordBatch.from_arrays([
                pa.array(r["key"]), pa.array(r["segment"]), batch.column("doc_id").take(pa.array(r["row"])), batch.column("th").take(pa.array(r["row"])),
                pa.array(r["start"]), pa.array(r["n"])], ["key", "segment", "doc_id", "th", "start", "n"])


def transform(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and length of every suffix of the strings, in suffix order; equal suffixes are in order of their strings.

    Each round inserts, for every string, the symbol before its next longer suffix into the transform. The suffix's
    place is that of its first symbol, the one inserted in the round before, among all equal symbols.
    """
    sizes = np.array([len(s) for s in strings])
    order = np.argsort(-sizes, kind="stable")
    m, longest = len(strings), int(sizes.max())
    flat = np.concatenate(strings)
    codes = np.zeros(256, np.uint8)
    used = np.unique(flat)
    codes[used] = np.arange(1, len(used) + 1)
    flat = codes[flat]
    ends = np.cumsum(sizes)
    # a string's rank decides between equal suffixes; strings stand in order of falling length, so the live ones are the first
    ends, sizes = ends[order], sizes[order]
    counts = np.searchsorted(-sizes, -np.arange(longest + 2), "right")

    def symbols(j: int) -> np.ndarray:
        """The symbols before the suffixes of length ``j``; none is before a whole string."""
        live = counts[j]
        out = np.zeros(live, np.uint8)
        more = counts[j + 1]
        out[:more] = flat[ends[:more] - j - 1]
        return out

    bwt, at = symbols(0), np.arange(m)
    for j in range(1, longest + 1):
        live = counts[j]
        at = _after(bwt, m)[at[:live]]
        grown = np.empty(len(bwt) + live, np.uint8)
        kept = np.ones(len(grown), bool)
        kept[at] = False
        grown[at] = symbols(j)
        grown[kept] = bwt
        bwt = grown
    step, owner, length = _after(bwt, m), np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    at = np.arange(m)
    for j in range(longest + 1):
        at = at[: counts[j]]
        owner[at], length[at] = order[: counts[j]], j
        at = step[at]
    return owner, length


def _after(bwt: np.ndarray, m: int) -> np.ndarray:
    """For every place, the place of the suffix that is longer by the symbol there; meaningless where there is none."""
    order = np.argsort(bwt, kind="stable")
    out = np.empty(len(bwt), np.int64)
    out[order] = np.arange(m - int((bwt == 0).sum()), m - int((bwt == 0).sum()) + len(bwt))
    return out


def repeated_starts(strings: list[np.ndarray]) -> list[np.ndarray]:
    """For every string, the offsets at which a string of ``LENGTH`` bytes starts that also starts elsewhere among them."""
    owner, length = transform(strings)
    full = np.flatnonzero(length >= LENGTH)
    owner, length = owner[full], length[full]
    sizes = np.array([len(s) for s in strings])
    begin = np.cumsum(sizes) - sizes
    flat = np.lib.stride_tricks.sliding_window_view(np.concatenate(strings), LENGTH)
    offset = sizes[owner] - length
    where = begin[owner] + offset
    same = np.zeros(len(where) + 1, bool)
    for k in range(0, len(where) - 1, 20_000):
        a, b = where[k : k + 20_000], where[k + 1 : k + 20_001]
        # neighbours in the whole order only: a shorter suffix between two cannot stand between equal strings
        same[k + 1 : k + 1 + len(b)] = (flat[a[: len(b)]] == flat[b]).all(axis=1)
    twice = same[:-1] | same[1:]
    owner, offset = owner[twice], offset[twice]
    by = np.lexsort((offset, owner))
    return np.split(offset[by], np.searchsorted(owner[by], np.arange(1, len(strings))))


def spans(offsets: np.ndarray) -> list[dict]:
    """Sorted offsets as runs (offset, n)."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) != 1) + 1
    return [{"offset": int(p[0]), "n": len(p)} for p in np.split(offsets, cut)]


_SPAN = pa.list_(pa.struct([("offset", pa.int64()), ("n", pa.int64())]))
_FOUND = "key long, segment long, repeats array<struct<offset: long, n: long>>"
_FOUND_ARROW = pa.schema([("key", pa.int64()), ("segment", pa.int64()), ("repeats", _SPAN)])


def _sort_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats in the segments of whole keys; rows come sorted by key."""
    held: list[tuple] = []
    size = 0

    def done():
        found = repeated_starts([np.frombuffer(b, np.uint8) for _, _, b in held])
        return pa.RecordBatch.from_pylist([{"key": k, "segment": s, "repeats": spans(f)} for (k, s, _), f in zip(held, found)], _FOUND_ARROW)

    for batch in batches:
        for key, segment, data in zip(*(batch.column(c).to_pylist() for c in ("key", "segment", "bytes"))):
            if size >= BUCKET and key != held[-1][0]:
                yield done()
                held, size = [], 0
            held.append((key, segment, data))
            size += len(data)
    if held:
        yield done()


_BLOCK = "key long, segment long, block long, offset long, n long, core long, cover long"


def _blocks(batches: Iterator[pa.RecordBatch], width: int, parent: int) -> Iterator[pa.RecordBatch]:
    """The blocks of ``width`` strings in some blocks of ``parent``, with the hash of what all their strings have in common and of what they cover.

    All strings of a segment hold the gram that is its key, and a string is named by the bytes before it. So equal
    strings of two segments of a key have one name and are in blocks of one name. A block of which a segment has a
    part only has no cover.
    """
    up, down = _powers(2 * _PIECE)
    most = LENGTH - GRAM
    for batch in batches:
        rows: list[tuple] = []
        for key, segment, data, parents in zip(*(batch.column(c).to_pylist() for c in ("key", "segment", "bytes", "parents"))):
            part = np.frombuffer(data, np.uint8)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUE[part] * up[: len(part)], out=total[1:])
            grams = mix((total[GRAM:] - total[:-GRAM]) * down[: len(part) - GRAM + 1])
            place = int(np.argmax(grams.view(np.int64) == key))
            least = place - (len(part) - LENGTH)
            low = np.concatenate([np.arange(x, min(x + parent, most + 1), width) for x in parents])
            high = np.minimum(low + width - 1, most)
            inside = (low <= place) & (high >= least)
            low, high = low[inside], high[inside]
            hashed = lambda x, y: mix((total[y] - total[x]) * down[x]).view(np.int64)
            core = hashed(place - low, place + LENGTH - high)
            whole = (high <= place) & (low >= least)
            cover = hashed(np.maximum(place - high, 0), np.minimum(place + LENGTH - low, len(part)))
            n = len(low)
            rows.append((np.full(n, key), np.full(n, segment), low, place - high, high - low + 1, core, cover, ~whole))
        if rows:
            *columns, without = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:-1]), pa.array(columns[-1], mask=without)], ["key", "segment", "block", "offset", "n", "core", "cover"])


def _counted(segments: DataFrame) -> DataFrame:
    """``key, segment, repeats`` of keys of many segments, by counting.

    A block whose cover another segment has repeats as a whole; one whose core no other has does not repeat at all;
    the others are cut. Of the segments with one cover, one is cut along with them, as others may share a part of it.
    """
    asked, parent, found = segments.withColumn("parents", F.array(F.lit(0))), LENGTH - GRAM + 1, []
    for width in BLOCKS:
        rows = materialise(asked.select("key", "segment", "bytes", "parents").mapInArrow(partial(_blocks, width=width, parent=parent), _BLOCK), "blocks")
        name = [F.col("key").alias("k"), F.col("block").alias("b")]
        cores = materialise(rows.groupBy(*name, F.col("core").alias("c")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"), "cores")
        covers = rows.where("cover IS NOT NULL").groupBy(*name, F.col("cover").alias("v")).agg(F.count(F.lit(1)).alias("times"), F.min("segment").alias("one"))
        covers = materialise(covers.where("times > 1").drop("times"), "covers")
        same = (F.col("key") == F.col("k")) & (F.col("block") == F.col("b"))
        shared = rows.join(cores, same & (F.col("core") == F.col("c"))).drop("k", "b").join(covers, same & (F.col("cover") == F.col("v")), "left")
        shared = materialise(shared.select("key", "segment", "block", "offset", "n", "one"), "shared-blocks")
        found.append(shared.where("one IS NOT NULL").select("key", "segment", "offset", "n"))
        cut = shared.where("one IS NULL OR one = segment").groupBy("key", "segment").agg(F.collect_list("block").alias("parents"))
        asked, parent = segments.join(cut, ["key", "segment"]), width
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans.groupBy("key", "segment").agg(F.collect_list(F.struct("offset", "n")).alias("repeats"))


def _segments(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``key, segment, bytes`` of all kinds of segments of some keys, read again from the texts."""
    place = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    one = F.lit(1).cast("long")
    words = mixed.groupBy(F.shiftright(place, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", one, place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for r in runs(data, offsets):
                maybe = np.flatnonzero(passes[r["key"] % FILTER_BITS])
                if not len(maybe):
                    continue
                _, one_each = np.unique(r["segment"][maybe], return_index=True)
                maybe = maybe[one_each]
                for k in range(0, len(maybe), 4096):
                    some = maybe[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(r["key"][some]), pa.array(r["segment"][some]),
                        pa.array([data[a : a + n + LENGTH - 1].tobytes() for a, n in zip(r["at"][some].tolist(), r["n"][some].tolist())], pa.binary())],
                        ["key", "segment", "bytes"])

    found = docs.select("text").mapInArrow(work, "key long, segment long, bytes binary").join(mixed.select("key"), "key")
    return materialise(found.groupBy("key", "segment").agg(F.first("bytes").alias("bytes")), "segments")


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, th, spans``: the starts, as runs (offset, n), of strings that also start elsewhere.

    ``docs``: doc_id, text and th, a hash of the text.
    """
    cut = materialise(docs.mapInArrow(_cut, _RUNS), "runs")
    keys = materialise(cut.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("segment").alias("low"), F.max("segment").alias("high")).where("times > 1"), "keys")
    again = cut.join(keys.select("key", (F.col("low") != F.col("high")).alias("mixed")), "key")
    again = materialise(again, "again")

    mixed = keys.where("low <> high").select("key")
    kinds = materialise(again.where("mixed").groupBy("key", "segment").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n")), "kinds")
    many = materialise(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > MOST).select("key"), "many")
    segments = _segments(docs, mixed)
    few = segments.join(many, "key", "left_anti").repartition("key").sortWithinPartitions("key", "segment")
    counted = _counted(segments.join(many, "key", "left_semi"))
    found = materialise(few.mapInArrow(_sort_keys, _FOUND).unionByName(counted), "found")
    # a segment that occurs twice repeats as a whole
    whole = kinds.where("times > 1").select("key", "segment", F.array(F.struct(F.lit(0).cast("long").alias("offset"), "n")).alias("whole"))
    verdict = materialise(found.join(whole, ["key", "segment"], "full").select(
        F.col("key").alias("k"), F.col("segment").alias("s"), F.coalesce("whole", "repeats").alias("repeats")).where(F.size("repeats") > 0), "verdict")
    parts = again.where("mixed").join(verdict, (F.col("key") == F.col("k")) & (F.col("segment") == F.col("s"))).select(
        "doc_id", "th", F.transform("repeats", lambda x: F.struct((F.col("start") + x["offset"]).alias("offset"), x["n"].alias("n"))).alias("spans"))
    full = again.where("NOT mixed").select("doc_id", "th", F.array(F.struct(F.col("start").alias("offset"), "n")).alias("spans"))
    return parts.unionByName(full).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(found: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """The bytes that strings at these starts cover, as sorted runs (from, to) with kept bytes between them."""
    out: list[tuple[int, int]] = []
    for s in sorted(found or [], key=lambda s: s["offset"]):
        low, high = s["offset"], s["offset"] + s["n"] + LENGTH - 1
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        rows = []
        for k in range(batch.num_rows):
            text, at, digest = data[offsets[k] : offsets[k + 1]], 0, hashlib.sha256()
            gone = covered(batch.column("spans")[k].as_py(), len(text))
            for low, high in gone:
                digest.update(text[at:low].tobytes())
                at = high
            digest.update(text[at:].tobytes())
            rows.append((len(text), sum(h - l for l, h in gone), len(gone), digest.hexdigest()))
        n, removed, count, sha = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    A byte goes if a string of ``LENGTH`` bytes covers it that starts anywhere else as well, in any text. A null text
    is empty; shorter texts keep all; rows equal in doc_id and text repeat each other like any equal texts; null ids
    are ids like others; an empty table gives an empty result; other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = materialise(repeats(docs).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "spans"), "repeats")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_digest, _RESULT)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
