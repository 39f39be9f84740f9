import random
import re

from modelkeel.llm import bottomk
from modelkeel.llm.components import components

SCHEMA = "doc_id long, text string, node long, key string, root int"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    out = []
    for i, (d, *_) in enumerate(rows):
        c = min((x for x in low[find(i)] if x is not None), default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def run(spark, rows, percent=85):
    df = bottomk.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), percent)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, shared = [], text(40)
    for _ in range(25):  # chains and stars of near copies around the limit, with a passage common to all
        words = text(rng.choice([12, 60, 300])) + shared
        for _ in range(8):
            rows.append(" ".join(words))
            if rng.random() < 0.6:
                words = list(words)
                for _ in range(rng.choice([1, 1, 2])):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rows += ["", None, " \n", "one two", "One  TWO", "one two three", "É a b c d", "é a b c d", "a b c d é", rows[0] * 1, rows[0].upper()]
    return [(i * 2 + 1, t, 1, "x", 2) for i, t in enumerate(rows)] + [(1, rows[20], 1, "x", 2), (None, rows[30], 1, "x", 2), (None, "only null id here x y", 0, "", 0)]


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows, 85)
    assert run(spark, rows, 80) == brute(rows, 80)


def test_empty(spark):
    assert run(spark, []) == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges + [(5, 5)], "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: r for n, r in root.items() if n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_in_rounds(spark, monkeypatch):
    from modelkeel.llm import components as module

    monkeypatch.setattr(module, "FEW_EDGES", 0)
    written = []
    monkeypatch.setattr(module, "materialise", lambda df, label, keep=module.materialise: written.append(label) or keep(df, label))
    test_components(spark)
    # the edges and one table for each of a few rounds, in two calls
    assert set(written) == {"edges"} and len(written) <= 9


def test_few_edges_need_no_rounds(spark, monkeypatch):
    from modelkeel.llm import components as module

    written = []
    monkeypatch.setattr(module, "materialise", lambda df, label, keep=module.materialise: written.append(label) or keep(df, label))
    test_components(spark)
    assert written == ["edges", "edges"]
