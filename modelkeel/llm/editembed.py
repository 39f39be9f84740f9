"""Document fingerprints by randomised edit embedding, with bit-sampled banding and verification.

A text is read by a shared random walk: at every step the walk writes the character it stands on, and a
random bit, fixed for the step and the character, says whether it moves on. Walks over texts that differ by
few edits meet again after an edit and from there on write the same, so edit distance becomes Hamming
distance. A fingerprint keeps one byte of a sample of the steps. The steps are sampled alike for all texts:
step ``s`` has a random level (half of the steps have level 1 or more, a quarter 2 or more, ...) and a text
keeps the steps of at least its own level, which its length decides, so two texts of different length share
the steps of the higher level.

Characters act through 16 classes and steps come in fours, so a step of four is one table look-up; the texts
of a batch walk side by side.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelkeel.llm.components import components
from modelkeel.llm.hashing import mix
from modelkeel.session import materialise

BATCH_CHARS = 4 << 20
SAMPLES = 64
PERIOD = 64
BANDS, BAND_BYTES, BAND_BITS = 10, 6, 4
#: Places of a band's sign, of four bits each, and how many may differ: 5.5 standard deviations at a likeness of 0.8.
SIGN_PLACES, SIGN_DIFFER = 16, 11
#: Places of the sign of a whole fingerprint, of two bits each.
WHOLE_PLACES = 128
#: Classes of a band up to which its pairs are taken by its key alone; beyond, by blocks of the fingerprints too.
FEW = 32


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and written byte of a character (by its low 16 bits), and how far four steps move over four classes."""
    h = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0xA5A5))
    classes, written = (h & np.uint64(15)).astype(np.uint16), ((h >> np.uint64(8)) & np.uint64(255)).astype(np.uint8)
    bits = np.random.default_rng(20).integers(0, 2, (PERIOD, 4, 16), dtype=np.uint8)
    code = np.arange(1 << 16)
    moves = np.zeros((PERIOD, 1 << 16), np.uint8)
    for k in range(4):
        here = (code >> (4 * moves.astype(np.int64))) & 15
        moves += np.take_along_axis(bits[:, k], here, axis=1)
    return classes, written, moves


@cache
def _levels(n: int) -> np.ndarray:
    """Random level of each of the first ``n`` steps: the trailing zeros of its hash."""
    h = mix(np.arange(n, dtype=np.uint64) + np.uint64(77)) | (np.uint64(1) << np.uint64(40))
    return np.log2((h & (~h + np.uint64(1))).astype(np.float64)).astype(np.int8)


def text_level(chars: np.ndarray) -> np.ndarray:
    """The sampling level of texts of so many characters: about ``SAMPLES`` to twice as many steps are kept."""
    steps = np.maximum(chars / 2, 1)
    return np.maximum(np.floor(np.log2(steps / SAMPLES)), 0).astype(np.int64)


def fingerprints(texts: list[str]) -> list[bytes]:
    """Fingerprint of each text: its level, then the kept bytes in step order. An empty text keeps none."""
    classes, written, moves = _tables()
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    chars = np.array([len(p) for p in points], np.int64)
    level = text_level(chars)
    order = np.argsort(-chars, kind="stable")
    flat = np.concatenate([np.append(points[i].astype(np.uint16), np.zeros(4, np.uint16)) for i in order]) if texts else np.empty(0, np.uint16)
    del points
    low = classes[flat]
    code = low.copy()
    for k in range(1, 4):
        code[:-k] |= low[k:] << np.uint16(4 * k)
    shown = written[flat]
    del low, flat
    sizes = chars[order]
    ends = np.cumsum(sizes + 4) - 4
    at = (ends - sizes).copy()
    # texts in order of length, so of falling level: those of a level or lower are a tail
    by_level = level[order]
    live, step = np.arange(len(texts)), 0
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    live = live[sizes[live] > 0]
    marks = _levels(1 << 12)
    while len(live):
        if step == len(marks):
            marks = _levels(2 * len(marks))
        z = marks[step]
        # live stays in order of length
        tail = live[np.searchsorted(-by_level[live], -int(z)):]
        if len(tail):
            kept.append((tail, shown[at[tail]]))
        at[live] += moves[step % PERIOD][code[at[live]]]
        step += 1
        over = at[live] >= ends[live]
        if over.any():
            live = live[~over]
    out: list[bytes] = [b""] * len(texts)
    if kept:
        who, what = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
        by = np.argsort(who, kind="stable")
        who, what = who[by], what[by]
        cut = np.searchsorted(who, np.arange(len(texts) + 1))
        for j, i in enumerate(order):
            out[i] = what[cut[j] : cut[j + 1]].tobytes()
    return [bytes([lv]) + b for lv, b in zip(level.tolist(), out)]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bytes at the steps both texts keep; steps beyond the shorter walk count as different."""
    top = max(a[0], b[0])
    x, y = _at_level(a, top), _at_level(b, top)
    longest = max(len(x), len(y))
    return float((x[: len(y)] == y[: len(x)]).sum() / longest) if longest else 1.0


def _at_level(a: bytes, level: int) -> np.ndarray:
    kept = np.frombuffer(a, np.uint8, offset=1)
    if a[0] == level:
        return kept
    n = 1 << 12
    while (own := np.flatnonzero(_levels(n) >= a[0])).size < kept.size:
        n *= 2
    return kept[_levels(n)[own[: kept.size]] >= level]


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


@cache
def _spans() -> list[int]:
    """1, 2, 3, ...: each the next whole number from 5/4 of the one before."""
    spans = [1]
    while spans[-1] < 1 << 20:
        spans.append(-(-spans[-1] * 5 // 4))
    return spans


@cache
def _band_places(k: int) -> np.ndarray:
    """Places of the bands of span ``k``, anywhere in its bytes."""
    n = _spans()[k]
    return np.random.default_rng((21, k)).permuted(np.tile(np.arange(n), (BANDS, 1)), axis=1)[:, :BAND_BYTES]


@cache
def _sign_places(k: int) -> np.ndarray:
    return np.random.default_rng((22, k)).permutation(_spans()[k])[:SIGN_PLACES]


def bands(fingerprint: bytes) -> dict[int, tuple[bool, int]]:
    """Keys of the bit-sampled bands, at the text's level and the next one, where a slightly longer text may be.

    The places of a band are drawn from a span of kept bytes. A text has the bands of the two largest spans that it
    fills: nearly all of it decides, wherever an edit is, and two texts have a span in common if the longer one keeps
    at most 5/4 of the bytes of the other, as they do at a likeness of 0.8. With each key comes whether it is of the
    text's own level, and the sign: other sampled bits of the same span.
    """
    found = {}
    for level in (fingerprint[0], fingerprint[0] + 1):
        kept = _at_level(fingerprint, level) & ((1 << BAND_BITS) - 1)
        largest = bisect_right(_spans(), len(kept)) - 1
        for k in range(max(largest - 1, 0), largest + 1):
            places = _band_places(k)
            values = kept[places].astype(np.int64) @ (1 << (BAND_BITS * np.arange(places.shape[1])))
            first = ((level * 64 + k) * BANDS + np.arange(BANDS)) << (BAND_BYTES * BAND_BITS)
            sign = sum(int(x) << (BAND_BITS * i) for i, x in enumerate(kept[_sign_places(k)]))
            found |= dict.fromkeys((first | values).tolist(), (level == fingerprint[0], sign))
    return found


def meet(a: bytes, b: bytes) -> bool:
    """Whether two fingerprints are candidates: a band of the higher of their levels in common, and signs that fit."""
    x, y = bands(a), bands(b)
    return any((x[k][0] or y[k][0]) and _differ(x[k][1] ^ y[k][1]) <= SIGN_DIFFER for k in x.keys() & y.keys())


def _differ(bits: int) -> int:
    """Groups of four bits that are not zero."""
    bits |= bits >> 1
    bits |= bits >> 2
    return (bits & 0x1111111111111111).bit_count()


_FIELDS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
           "near_next double")
_COLUMNS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(),
}
_EDGE = {"part": pa.int32(), "edge": pa.string(), "text": pa.string()}


def _compare(docs: list[tuple], following: list[str]) -> list[dict]:
    """Result rows of (doc_id, text) pairs, each beside the text that follows it."""
    texts = [t for _, t in docs]
    changed = [edited(t, f) for t, f in zip(texts, following)]
    found = fingerprints(texts + changed + [f for k, f in enumerate(following) if k + 1 == len(texts) or f is not texts[k + 1]])
    own, after, rest = found[: len(texts)], found[len(texts) : 2 * len(texts)], iter(found[2 * len(texts) :])
    rows = []
    for k, (doc_id, text) in enumerate(docs):
        nxt = next(rest) if k + 1 == len(texts) or following[k] is not texts[k + 1] else own[k + 1]
        rows.append({
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": own[k].hex(), "edited_fingerprint": after[k].hex(),
            "near_edited": likeness(own[k], after[k]), "near_next": likeness(own[k], nxt)})
    return rows


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range; its first and last document are given out too, as the edges of the range."""
    part, held, size, first = TaskContext.get().partitionId(), [], 0, True
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for k in range(batch.num_rows):
            held.append((ids[k].as_py(), texts[k].as_py()))
            size += len(held[-1][1])
            if first:
                yield pa.RecordBatch.from_pylist([{"part": part, "edge": "first", "text": held[0][1]}], schema)
                first = False
            if size >= BATCH_CHARS and len(held) > 1:
                yield pa.RecordBatch.from_pylist(_compare(held[:-1], [t for _, t in held[1:]]), schema)
                held = held[-1:]
                size = len(held[0][1])
    if len(held) > 1:
        yield pa.RecordBatch.from_pylist(_compare(held[:-1], [t for _, t in held[1:]]), schema)
    if held:
        yield pa.RecordBatch.from_pylist([{"part": part, "edge": "last", "doc_id": held[-1][0], "text": held[-1][1]}], schema)


def _pairs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist(_compare([(row["doc_id"], row["text"])], [row["following"]]), schema)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, their likeness, and that to the next document.

    The next document is that of the next doc_id, after the last one the first. Documents are sorted in ranges;
    within a range the next one is at hand, and the edges of the ranges (two texts for each) are paired afterwards.
    A null doc_id comes first, documents of one doc_id are ordered by text and all kept; a null text is empty; an
    empty text has likeness 1 to an empty one and 0 to others; a single document follows itself; an empty table
    gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "text")
    walked = materialise(ranged.mapInArrow(partial(_walk, schema=pa.schema(_COLUMNS | _EDGE)), _FIELDS + ", part int, edge string, text string"), "walks")
    heads = walked.where("edge = 'first'").select("part", "text")
    order = Window.orderBy("part")
    after = heads.select(F.col("part").alias("own"), F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part"))
    tails = walked.where("edge = 'last'").select("doc_id", "text", F.col("part").alias("own"))
    pairs = tails.join(after, "own").join(heads.select(F.col("part").alias("next_part"), F.col("text").alias("following")), "next_part")
    joined = pairs.select("doc_id", "text", "following").mapInArrow(partial(_pairs, schema=pa.schema(_COLUMNS)), _FIELDS)
    return walked.where("edge IS NULL").select(*_COLUMNS).unionByName(joined)


def blocks(fingerprint: bytes, least: float) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """Keys such that any two fingerprints whose likeness is at least ``least`` have one in common.

    Places at which two such fingerprints of at most ``n`` bytes differ are at most ``(1 - least) * n``. Dealt round
    robin into more blocks than that, at least one block has none of them and is equal as a whole. The number of
    blocks depends on the longer of the two, so a text has the keys for every length that its partner may have.
    Given by level, the own one first: whether it is the own one, the kept bytes, and the keys.
    """
    found = []
    for level in (fingerprint[0], fingerprint[0] + 1):
        kept = _at_level(fingerprint, level)
        if not len(kept):
            continue
        keys, longest = [], int(len(kept) / least + 1e-9)
        written = mix((np.arange(1, len(kept) + 1, dtype=np.uint64) << np.uint64(8)) | kept)
        for n in sorted({_dealt(m, least) for m in range(len(kept), longest + 1)}):
            padded = np.zeros(-(-len(kept) // n) * n, np.uint64)
            padded[: len(kept)] = written
            own = np.uint64(level << 40) | (np.uint64(n) << np.uint64(20)) | np.arange(n, dtype=np.uint64)
            keys.append(mix(padded.reshape(-1, n).sum(axis=0) + mix(own)))
        found.append((level == fingerprint[0], kept, np.concatenate(keys)))
    return found


def _dealt(longest: int, least: float) -> int:
    """Blocks for pairs whose longer fingerprint has so many bytes, in steps of four so that few numbers are needed."""
    return (int((1 - least) * longest + 1e-9) // 4 + 1) * 4


def whole_sign(kept: np.ndarray, shift: int = 0) -> np.ndarray:
    """Two bits of each of the first ``WHOLE_PLACES`` kept bytes: differing signs never overstate differing bytes."""
    two = np.zeros(WHOLE_PLACES, np.uint64)
    two[: len(kept)] = (kept[:WHOLE_PLACES] >> shift) & 3
    return (two.reshape(-1, 32) << (np.uint64(2) * np.arange(32, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


#: The four signs of a fingerprint, two bits of each byte a sign; together they are its bytes.
_SIGNS = [[f"w{i}_{shift}" for i in range(WHOLE_PLACES // 32)] for shift in range(0, 8, 2)]
_WORDS = [w for sign in _SIGNS for w in sign]
_ENTRY = "node long, root long, key long, own boolean, bytes int, " + ", ".join(f"{w} long" for w in _WORDS)


def _keyed(batches: Iterator[pa.RecordBatch], least: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """An entry for every block key of a fingerprint, with the signs of the whole at that level."""
    for batch in batches:
        for row in batch.to_pylist():
            for own, kept, keys in blocks(bytes.fromhex(row["fingerprint"]), least):
                n = len(keys)
                same = lambda x, kind: pa.array(np.full(n, x, kind))
                signs = [same(w, np.int64) for shift in range(0, 8, 2) for w in whole_sign(kept, shift)]
                yield pa.RecordBatch.from_arrays([same(row["node"], np.int64), same(row["root"], np.int64), pa.array(keys.view(np.int64)), same(own, bool),
                                                  same(len(kept), np.int32), *signs], schema=schema)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [bands(bytes.fromhex(f)) for f in batch.column("fingerprint").to_pylist()]
        nodes = np.repeat(batch.column("node").to_numpy(), [len(x) for x in found])
        flat = [(key, own, sign) for x in found for key, (own, sign) in x.items()]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.bool_()),
                                          pa.array(np.array([x[2] for x in flat], np.uint64).view(np.int64))], ["node", "band", "own", "sign"])


def _fits(x: str, y: str):
    """Whether two entries of a band are of the higher level of the two texts and their signs differ little."""
    bits = F.col(f"{x}sign").bitwiseXOR(F.col(f"{y}sign"))
    bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
    bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
    return (F.col(f"{x}own") | F.col(f"{y}own")) & (F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111))) <= SIGN_DIFFER)


def _few_differ(least: float):
    """Whether two whole fingerprints differ at no more of their first places than near ones may: one sign, then all bytes."""
    def differing(signs: list[list[str]]):
        count = F.lit(0)
        for words in zip(*signs):
            bits = reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}")) for w in words])
            count = count + F.bit_count(bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        return count

    most = F.floor(F.greatest("x.bytes", "y.bytes") * (1 - least) + F.lit(1e-6))
    return (F.col("x.own") | F.col("y.own")) & (differing(_SIGNS[:1]) <= most) & (differing(_SIGNS) <= most)


def _near(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those pairs ``a, b`` of classes that are candidates and whose fingerprints are alike enough, byte by byte."""
    both = pairs
    for side in ("b", "a"):
        both = both.join(classes.select(F.col("node").alias(side), F.col("fingerprint").alias(f"print_{side}")), side)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [[bytes.fromhex(x) for x in batch.column(f"print_{side}").to_pylist()] for side in "ab"]
            keep = [likeness(x, y) >= least and meet(x, y) for x, y in zip(*prints)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(verify, "a long, b long"), "near-pairs")


def _across_few(members: DataFrame) -> DataFrame:
    """Candidates ``a, b`` of different components among the members of bands of few."""
    x, y = members.alias("x"), members.alias("y")
    apart = (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root")) & _fits("x.", "y.")
    return x.join(y, apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _across_many(members: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of different components among the members of large bands that may be near.

    Near ones share a block. Of each key the members of the component with most of them are only compared with
    the others, so a large component costs nothing where it is alone.
    """
    nodes = members.groupBy("node").agg(F.first("root").alias("root")).join(classes.select("node", "fingerprint"), "node")
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("key", pa.int64()), ("own", pa.bool_()), ("bytes", pa.int32()), *((w, pa.int64()) for w in _WORDS)])
    entries = materialise(nodes.select("node", "root", "fingerprint").mapInArrow(partial(_keyed, least=least, schema=schema), _ENTRY), "block-keys")
    sizes = entries.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    shown = materialise(entries.join(most.select("key", F.col("m.root").alias("most")), "key"), "open-blocks")
    x, y = shown.where("root <> most").alias("x"), shown.alias("y")
    # both of a pair may be of smaller components: then one order of the two is enough
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.most")) | (F.col("x.root") < F.col("y.root")))
    return x.join(y, apart & _few_differ(least)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def near_classes(found: DataFrame, least: float = 0.8) -> DataFrame:
    """``doc_id, class_id``: the smallest doc_id that a document is linked to by near pairs, however far.

    Two documents are linked if their fingerprints are candidates (see :func:`meet`) and alike enough. Documents of
    equal fingerprints are one class from the start. A band's classes are first compared with one of them; the
    components that this makes need no comparison inside. Only the members of a band that then still stand apart
    are compared with each other: by the band's key and signs where they are few, otherwise where they share one
    of the :func:`blocks`, which loses no near pair. So a band of any size costs a candidate or two a row where its
    documents are alike.

    A document without a text, or linked to none, is its own class. Documents of one doc_id get the smallest class of
    them. Rows without a doc_id are left out. An empty table gives an empty result.
    """
    docs = found.where("n_chars > 0 AND doc_id IS NOT NULL").select("doc_id", "fingerprint")
    classes = materialise(docs.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", "fingerprint").mapInArrow(_banded, "node long, band long, own boolean, sign long")
    leaders = keys.groupBy("band").agg(F.min(F.struct((~F.col("own")).alias("other"), "node", "sign")).alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1")
    leaders = materialise(leaders.select("band", "size", F.col("m.node").alias("lead"), (~F.col("m.other")).alias("lead_own"), F.col("m.sign").alias("lead_sign")), "band-leaders")
    fits = _fits("", "lead_")
    shared = materialise(keys.join(leaders, "band").where((F.col("node") != F.col("lead")) & ((F.col("size") > 2) | fits)).withColumn("fits", fits)
                         .select("band", "size", "node", "own", "sign", "lead", "fits"), "bands")
    stars = shared.where("fits").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    joined = materialise(components(_near(stars, classes, least)), "joined")

    members = shared.where("size > 2").join(joined, "node", "left").select("band", "size", "node", "own", "sign", F.coalesce("root", "node").alias("root"))
    apart = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    members = materialise(members.join(apart, "band"), "members")
    across = _across_few(members.where(F.col("size") <= FEW)).union(_across_many(members.where(F.col("size") > FEW), classes, least))
    links = _near(across.distinct(), classes, least)
    # links between components join their roots
    for side in ("a", "b"):
        links = links.join(joined.select(F.col("node").alias("n"), "root"), F.col(side) == F.col("n"), "left").withColumn(side, F.coalesce("root", side)).drop("n", "root")
    tops = materialise(components(links), "tops").select(F.col("node").alias("under"), F.col("root").alias("top"))
    roots = classes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")).join(tops, F.col("root") == F.col("under"), "left")
    roots = materialise(roots.select("fingerprint", "first_id", F.coalesce("top", "root").alias("root")), "roots")
    ids = roots.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = docs.join(roots.join(ids, "root").select("fingerprint", "class_id"), "fingerprint")
    alone = found.where("n_chars = 0 AND doc_id IS NOT NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return named.select("doc_id", "class_id").union(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def op1_edit_fingerprint(spark, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.join(near_classes(found), "doc_id", "left")
