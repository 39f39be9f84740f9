import random
import re
from collections import Counter

import numpy as np

from modelkeel.llm import decontam as dc

DOCS = "doc_id long, text string, item_id long, similarity string"
ITEMS = "item_id long, text string, doc_id int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, least):
    out = Counter()
    for d, t, *_ in docs:
        w, here = words(t), {}
        for i, it, *_ in items:
            m = words(it)
            size = min(5, len(m)) or 1
            want = Counter(tuple(m[k:k + size]) for k in range(len(m) - size + 1))
            for s in range(len(w) - len(m) + 1) if m else ():
                part = w[s:s + len(m)]
                got = Counter(tuple(part[k:k + size]) for k in range(len(m) - size + 1))
                both = sum((got & want).values())
                alike = both / (2 * sum(want.values()) - both)
                if alike >= least:
                    best, n = here.get(i, (0, 0))
                    here[i] = max(best, alike), n + 1
        for i, (s, n) in here.items():
            out[d, i, round(s, 9), n] += 1
    return out


def test_block_neighbours_guarantee_the_radius():
    rng = np.random.default_rng(1)
    for _ in range(300):
        bits = rng.choice(64, dc.RADIUS, replace=False)
        x = int(sum(1 << int(b) for b in bits))
        assert any((x >> low & (1 << width) - 1).bit_count() <= dc.NEAR_BITS for low, width in dc.BLOCKS)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 7)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([5, 8, 16, 30, 60])), 0) for i in range(20)] + [(20, "a a a a a a a a a", 0), (21, "Two words", 0), (22, None, 0), (23, " ", 0), (24, "one", 0)]
    docs = []
    for d in range(120):
        body = text(rng.randint(0, 150)).split()
        for _ in range(rng.randint(0, 2)):
            leak = rng.choice(items[:21])[1].upper().split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(leak) // 3])):
                leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            at = rng.randint(0, len(body))
            body[at:at] = leak
        docs.append((d, "\n".join(body), 1, "x"))
    docs += [(500, None, 1, ""), (501, "", 1, ""), (502, "two\twords one", 1, ""), (502, "two\twords one", 1, ""), (None, items[0][1], 1, ""), (503, "a " * 5000, 0, ""), (504, "x" * 2_500_000 + " " + items[3][1], 0, "")]
    d, b = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS)
    got = Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9), r["n_windows"]) for r in dc.find_leaks(d, b).collect())
    assert got == brute(docs, items, 0.8) and len(got) > 40
    clean = dc.drop_leaking(d, b)
    assert clean.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(x[0]) for x in docs if x[0] not in {k[0] for k in got})


def test_empty(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e", 0)], ITEMS)
    assert dc.find_leaks(none, some).collect() == []
    one = spark.createDataFrame([(1, "a b c d e f", 0, "")], DOCS)
    assert dc.find_leaks(one, some.limit(0)).collect() == [] and dc.drop_leaking(one, some.limit(0)).count() == 1


def brute_longer(docs, items, least):
    """Items that are longer than the document: its whole shingles against theirs."""
    out = {}
    shingles = lambda w: Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    for d, t, *_ in docs:
        for i, it, *_ in items:
            w, m = words(t), words(it)
            if len(m) > len(w) >= 5:
                a, b = shingles(w), shingles(m)
                alike = sum((a & b).values()) / sum((a | b).values())
                if alike >= least:
                    out[d, i] = round(alike, 9), 1
    return out


def test_documents_shorter_than_the_item(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 9)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    same = text(20)
    items = [(i, text(n), 0) for i, n in enumerate([9, 10, 13, 14, 20, 40, 60, 60, 200])] + [(10, "a b " * 15, 0)] + [(20 + i, same + " " + text(40), 0) for i in range(8)]
    docs = []
    for i, it, _ in items:
        w = it.split()
        for cut in range(1, len(w) // 4 + 1):
            docs += [w[:-cut], w[cut:], w[cut // 2 : len(w) - cut + cut // 2]]
            changed = w[:-cut]
            changed[rng.randrange(len(changed))] = "other"
            docs.append(changed)
    docs = [(d, " ".join(w).upper(), 1, "") for d, w in enumerate(docs)]
    d, b = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = brute_longer(docs, items, 0.8)
    assert {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["n_windows"]) for r in dc.find_leaks(d, b).collect()} == want and len(want) > 100
    assert {r["doc_id"] for r in dc.drop_leaking(d, b).collect()} == {x[0] for x in docs} - {k[0] for k in want}
