import hashlib
import random

import pytest

from modelkeel.llm import editembed as ee

SCHEMA = "doc_id long, text string, n_chars string, part int, bands int"
RNG = random.Random(3)


def prose(n):
    return " ".join("".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randint(1, 9))) for _ in range(n))


def walk(text):
    """The walk, one text and one character at a time."""
    classes, written, moves = ee._tables()
    level, at, step, kept = int(ee.text_level(ee.np.array([len(text)]))[0]), 0, 0, []
    codes = [ord(c) & 0xFFFF for c in text] + [0] * 4
    low = [int(classes[c]) for c in codes] + [0] * 4
    low[len(text):] = [int(classes[0])] * (len(low) - len(text))
    while at < len(text):
        if ee._levels(1 << 16)[step] >= level:
            kept.append(int(written[codes[at]]))
        at += int(moves[step % ee.PERIOD][sum(low[at + k] << 4 * k for k in range(4))])
        step += 1
    return bytes([level, *kept])


def test_batch_is_the_walk():
    texts = [prose(n) for n in (1, 3, 30, 300, 900)] + ["", "é" * 50, "\U0001f600x"]
    got = ee.fingerprints(texts)
    assert [g[:1 + 40] for g in got] == [walk(t)[:41] for t in texts]
    assert [len(g) for g in got] == [len(walk(t)) for t in texts]
    assert ee.fingerprints(texts[::-1])[::-1] == got


def test_few_edits_stay_near():
    for n in (60, 200, 800, 3000):
        text = prose(n)
        words = text.split(" ")
        words[n // 2] = "insertedword"
        near, far = " ".join(words), prose(n)
        a, b, c = ee.fingerprints([text, near, far])
        assert ee.likeness(a, b) > 0.6 > 0.35 > ee.likeness(a, c)


def test_query_rows(spark):
    texts = [prose(RNG.randint(1, 400)) for _ in range(60)] + ["", None, "x"]
    rows = [(3 * i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1, 2), (None, "null id " + texts[3], "", 0, 0)]
    ee.BATCH_CHARS, before = 4000, ee.BATCH_CHARS
    try:
        found = ee.fingerprint_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)).cache()
        got = [r.asDict() for r in found.collect()]
    finally:
        ee.BATCH_CHARS = before
    order = sorted(((i is not None, i or 0, t or "") for i, t, *_ in rows))
    want = []
    for k, (known, i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][2]
        changed = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = (walk(x) for x in (t, changed, nxt))
        want.append((i if known else None, len(t), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), ee.likeness(a, b), ee.likeness(a, c)))
    assert sorted(want, key=repr) == sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got), key=repr)


def test_near_classes(spark):
    base = [prose(300) for _ in range(20)]
    rows = [(i, t, "", 0, 0) for i, t in enumerate(base)] + [(100 + i, t + " more", "", 0, 0) for i, t in enumerate(base)]
    rows += [(200, base[0], "", 0, 0), (201, None, "", 0, 0), (202, "", "", 0, 0), (None, base[1], "", 0, 0), (203, base[2], "", 0, 0), (203, base[1], "", 0, 0)]
    found = ee.near_classes(ee.fingerprint_documents(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == sorted([(i, i) for i in range(20)] + [(100 + i, i) for i in range(20)] + [(200, 0), (201, 201), (202, 202), (203, 1)])
    assert ee.near_classes(ee.fingerprint_documents(spark.createDataFrame([], SCHEMA))).collect() == []


def test_edges(spark):
    assert ee.fingerprint_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    one = ee.fingerprint_documents(spark.createDataFrame([(1, "abcdefgh", "", 0, 0)], SCHEMA)).collect()
    assert [(r["n_chars"], r["near_next"]) for r in one] == [(8, 1.0)]


def classes(found, least=0.8):
    """The class of each document by comparing all pairs of candidates."""
    up = {d: d for d in found}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for d, f in found.items():
        for e, g in found.items():
            if e < d and ee.likeness(f, g) >= least and ee.meet(f, g):
                x, y = sorted((root(d), root(e)))
                up[y] = x
    return {d: root(d) for d in found}


@pytest.mark.parametrize("few", [1, 8, 1000])
def test_every_near_pair_of_a_band(spark, monkeypatch, few):
    monkeypatch.setattr(ee, "FEW", few)
    passage = prose(60)[:300]
    texts = [passage + " " + prose(60)[:200] for _ in range(40)]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts)] + [(200 + i, t + " more") for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:20]):
        words = t.split(" ")
        words[20:25] = prose(5).split(" ")
        rows.append((300 + i, " ".join(words)))
    found = dict(zip([d for d, _ in rows], ee.fingerprints([t for _, t in rows])))
    docs = spark.createDataFrame([(d, t, "", 0, 0) for d, t in rows], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in ee.near_classes(ee.fingerprint_documents(docs)).collect()}
    assert got == classes(found) and got[139] == 39 and len(set(got.values())) > 30


def test_copies_apart_from_the_leader(spark):
    rows = []
    for k in range(0, 1000, 100):
        passage = prose(70)[:330]
        a, b = (passage + " " + prose(50)[:170] for _ in range(2))
        rows += [(k + 1, a, "", 0, 0), (k + 50, b, "", 0, 0), (k + 60, b, "", 0, 0)]
    got = {r["doc_id"]: r["class_id"] for r in ee.near_classes(ee.fingerprint_documents(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert {d: got.get(d) for d in range(60, 1000, 100)} == {d: d - 10 for d in range(60, 1000, 100)}


def test_blocks_meet_at_the_threshold():
    rng = ee.np.random.default_rng(4)
    for n in [*range(1, 140, 3), 127]:
        a = rng.integers(0, 256, n, dtype=ee.np.uint8)
        for short in {n, max(1, n - n // 10)}:
            b = a[:short].copy()
            left = n // 5 - (n - short)
            b[rng.choice(short, left, replace=False)] += 1
            x, y = bytes([3]) + a.tobytes(), bytes([3]) + b.tobytes()
            assert ee.likeness(x, y) >= 0.8
            mine, other = (dict(zip((own for own, _, _ in ee.blocks(z, 0.8)), ee.blocks(z, 0.8))) for z in (x, y))
            assert set(mine[True][2].tolist()) & set(other[True][2].tolist())
            bits = [int(u ^ v) & (1 << 64) - 1 for u, v in zip(ee.whole_sign(mine[True][1]), ee.whole_sign(other[True][1]))]
            assert sum(((u | u >> 1) & 0x5555555555555555).bit_count() for u in bits) <= int(0.2 * n + 1e-6)


def test_edits_anywhere_share_a_band():
    RNG.seed(6)
    pairs, places = [], []
    for _ in range(300):
        words = prose(RNG.choice([85, 100, 170, 320])).split(" ")
        n = len(words)
        for place, at in (("start", 0), ("middle", n * 2 // 5), ("end", n - n // 6)):
            changed = words.copy()
            changed[at : at + n // 6] = prose(n // 6).split(" ")
            pairs += [" ".join(words), " ".join(changed)]
            places.append(place)
    prints = ee.fingerprints(pairs)
    near, met = ee.np.zeros(3), ee.np.zeros(3)
    for k, place in enumerate(places):
        a, b = prints[2 * k], prints[2 * k + 1]
        if ee.likeness(a, b) >= 0.8:
            near[k % 3] += 1
            met[k % 3] += ee.meet(a, b)
    assert near.min() > 20 and (met / near).min() > 0.97
    short = ee.fingerprints(["x", "xy", "a b", prose(2), prose(5)])
    assert all(ee.bands(f) for f in short)


def test_very_long_texts(spark):
    long = prose(300_000)
    rows = [(5, long, "", 0, 0), (6, long[:700_000] + "an edit" + long[700_000:], "", 0, 0), (7, long[::-1], "", 0, 0), (8, "short", "", 0, 0)]
    found = ee.fingerprint_documents(spark.createDataFrame(rows, SCHEMA))
    assert {r["doc_id"]: r["n_chars"] for r in found.collect()} == {d: len(t) for d, t, *_ in rows}
    assert {r["doc_id"]: r["class_id"] for r in ee.near_classes(found).collect()} == {5: 5, 6: 5, 7: 7, 8: 8}


def test_large_bands_pair_only_what_is_near(spark):
    """Fingerprints of one passage, at 0.68 to 0.9 of each other: no pair comes out that is not near, and none is lost."""
    rng = ee.np.random.default_rng(5)
    base, prints = rng.integers(0, 256, 100, dtype=ee.np.uint8), []
    for k in range(60):
        kept = base.copy()
        kept[rng.choice(100, 6 + k % 12, replace=False)] = rng.integers(0, 256, 6 + k % 12, dtype=ee.np.uint8)
        prints.append(b"\x00" + kept.tobytes())
    classes = spark.createDataFrame([(k, p.hex()) for k, p in enumerate(prints)], "node long, fingerprint string")
    members = spark.createDataFrame([(k, k // 2) for k in range(60)], "node long, root long")
    got = {(r["a"], r["b"]) for r in ee._across_many(members, classes, 0.8).collect()}
    alike = {(a, b): ee.likeness(prints[a], prints[b]) for a in range(60) for b in range(a + 1, 60) if a // 2 != b // 2}
    assert got == {pair for pair, x in alike.items() if x >= 0.8}
    assert min(alike.values()) < 0.75 and len(got) < len(alike)
