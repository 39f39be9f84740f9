import hashlib
import random
import re
import zlib

from modelkeel.llm import periodic

SCHEMA = "doc_id long, text string, start string, runs long, doc string"


def brute(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i + q - s
            if n >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(s, s + n - d)) for d in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def text(rng):
    kinds, words = rng.choice([1, 2, 3, 8]), []
    for _ in range(rng.randint(0, 14)):
        block = [rng.choice("abcdeÉgh"[:kinds]) for _ in range(rng.choice([1, 1, 2, 3, 4, 7, 12]))]
        words += block * rng.choice([1, 1, 2, 4, 5, 9])
    return rng.choice([" ", "\t", " \n"]).join(words)


def corpus():
    rng = random.Random(13)
    rows = [(i, text(rng), "s", i, "d") for i in range(600)]
    many = " ".join(f"w{i % 701}" for i in range(60000))
    return rows + [(700, None, "", 0, ""), (701, "", "", 0, ""), (702, " \t\n", "", 0, ""), (None, rows[3][1], "", 0, ""), (3, rows[3][1], "", 0, ""),
                   (704, "a b " * 6, "", 0, ""), (705, many, "", 0, ""), (706, "x " * 100000, "", 0, "")]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def expected(t):
    words = words_of(t)
    if len(words) > 5000:
        found = [(0, len(words), 1 if words[0] == words[1] else 701)]
    else:
        found = brute(words)
    return found, collapsed(words, found)


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()]
    want = [(r[0], *expected(r[1])) for r in rows]
    assert sum(len(x[1]) for x in want) > 500
    assert sorted(got, key=repr) == sorted(want, key=repr)


def edited(i, words):
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_query(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 704]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, *_ in rows:
        words = edited(i, words_of(t))
        found = brute(words)
        top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        want.append((i, len(found), *top, 1000 * top[1] // top[2] if found else None, digest, hashlib.sha256(collapsed(words, found).encode()).hexdigest()))
    got = [tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_guaranteed_grams():
    for j in range(8):
        for q in range(1 << j, 2 << j):
            assert q <= periodic._gram_length(j) <= max(6, 4 * q) - q


def test_empty(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
