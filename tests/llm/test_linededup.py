import random
import re

from modelkeel.llm import linededup

SCHEMA = "doc_id long, text string, sid long, n string, at int"


def token_set(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))


def brute(rows, hashes):
    """Removed lines of each (doc_id, text)."""
    lines = []
    for d, t in {(r[0], r[1]) for r in rows if r[1] is not None}:
        lines += [((d is not None, d or 0, hashes[t], i), (d, t), token_set(x)) for i, x in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: x[0])
    out = {}
    for k, (at, doc, s) in enumerate(lines):
        if s and any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:k] if o):
            out.setdefault(doc, []).append(at[3])
    return out


def corpus():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 4]))) for _ in range(400)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 25, 60]))) for _ in range(120)]
    rows = []
    for d in range(150):
        text = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(lines).split() if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text.append(rng.choice([" ", "\t"]).join(words).upper() if rng.random() < 0.1 else " ".join(words))
            if rng.random() < 0.2:
                text.append("")
        rows.append((d, "\n".join(text), 1, "x", 2))
    same = rows[3][1]
    return rows + [(200, None, 0, "", 0), (201, "", 0, "", 0), (202, "\n\n", 0, "", 0), (None, same, 0, "", 0), (7, same, 0, "", 0), (7, same, 0, "", 0),
                   (300, "hot line of words here\n" * 40 + "x " * 3000, 0, "", 0)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    want = brute(rows, hashes)
    assert sum(map(len, want.values())) > 80
    of = {h: t for t, h in hashes.items()}
    got = {(r["doc_id"], of[r["th"]]): r["removed"] for r in linededup.duplicate_lines(docs).collect()}
    assert got == want
    kept = linededup.remove_lines(docs)
    assert kept.columns == docs.columns
    left = sorted(((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get((d, t), ()))) for d, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == left


def test_signatures_of_either_length(spark):
    # sets about the size at which the signature gets longer: partners on both sides of it, and more changes than fit
    rng = random.Random(7)
    base = [f"w{i}" for i in range(linededup.LONG_SET + 4)]
    rows = []
    for d in range(60):
        words = base[:rng.randint(linededup.LONG_SET - 8, linededup.LONG_SET + 4)]
        for _ in range(rng.choice([0, 3, 9, 12, 40])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(500)}"
        rows.append((d, " ".join(words), 1, "x", 2))
    docs = spark.createDataFrame(rows, SCHEMA)
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    want = {d for d, _ in brute(rows, hashes)}
    assert 10 < len(want) < 55
    assert {r["doc_id"] for r in linededup.duplicate_lines(docs).collect()} == want


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a b\na b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = linededup.op6_line_dedup(spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [(1, 2, 1, [1])]
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_empty(spark):
    assert linededup.duplicate_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lines_carry_no_whole_text_and_words_are_hashed_once(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e f g", 0, "", 0)], SCHEMA).select("doc_id", "text")
    lines = linededup._lines(docs)
    above, below = lines._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode", 1)
    assert "xxhash64(text" in below and "xxhash64(text" not in above
    plan = linededup._word_sets(lines, linededup.slot_ranks(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Generate posexplode")[0].count("xxhash64(lambda") == 1


def test_texts_are_cut_once_and_numbers_sorted_as_plain_longs(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e\tf g", 0, "", 0), (2, None, 0, "", 0)], SCHEMA).select("doc_id", "text")
    lines = linededup._lines(docs)
    # an inner explode had the texts cut again to see that there are lines
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
    sets = linededup._word_sets(lines, linededup.slot_ranks(docs))
    assert not sets.schema["ids"].dataType.containsNull
    assert sorted(len(r["ids"]) for r in sets.collect()) == [3, 4]


def test_slots_are_ordered_by_their_words(spark):
    docs = spark.createDataFrame([(1, "b b\tB\va\n\na C", 0, "", 0), (2, None, 0, "", 0), (3, " ", 0, "", 0)], SCHEMA).select("doc_id", "text")
    rare = linededup._word_sets(linededup._lines(docs), linededup.slot_ranks(docs)).collect()
    assert sorted(len(r["ids"]) for r in rare) == [0, 0, 2, 2]
    ab, ac = [r["ids"] for r in rare if len(r["ids"]) == 2]
    a = set(ab) & set(ac)
    assert len(a) == 1 and [x in a for x in ab] == [True, False] and [x in a for x in ac] == [False, True]
