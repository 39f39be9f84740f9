from collections import defaultdict

import pytest

from modelkeel.llm.mixing import copies, mix, take

SCHEMA = "doc_id long, text string, source string, size string, rank int"


def rows(spark, data):
    return [r.asDict() for r in mix(spark.createDataFrame(data, SCHEMA)).collect()]


def brute_targets(sizes):
    """The rule step by step: share by weight, stop at twice the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return target


def test_targets_and_words(spark):
    data = [(i, "w " * (1 + i * i % 37), ["a", "b", "c", "d", None, "hot"][min(i % 9, 5)], "x", i) for i in range(900)]
    got = rows(spark, data)
    assert len(got) == 900
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02)
    assert sorted(map(str, got)) == sorted(map(str, rows(spark, data[::-1])))


def test_odd_rows(spark):
    data = [(None, "a b", None, None, None), (1, None, "s", None, 1), (1, "", "s", None, 1), (2, "a b c", "s", None, 1), (2, "a b c", "s", None, 1)]
    got = rows(spark, data)
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 2]
    assert rows(spark, []) == []
    assert [(r["target"], r["taken"]) for r in rows(spark, [(1, None, "s", None, 1)])] == [(0.0, 0)]


def test_texts_are_what_the_plan_takes(spark):
    data = [(i, f" w{i}\n" + "w \tx " * (i * i % 37) + "end ", ["a", "b", "c", "d", None, "hot"][min(i % 9, 5)], "x", i) for i in range(400)]
    data += [(None, "a b", None, None, None), (1, None, "s", None, 1), (1, " ", "s", None, 1)] + [(2, "a b c", "s", None, 1)] * 2 + [(2, "a b d", "s", None, 1), (3, "big \n" * 3000, "s", None, 1)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = [r.asDict() for r in take(docs).collect()]
    plan = lambda rows: sorted(str({k: v for k, v in r.items() if k != "texts"}) for r in rows)
    assert plan(got) == plan(r.asDict() for r in mix(docs).collect())
    given = {(d, s, t) for d, t, s, *_ in data}
    for r in got:
        whole, part = r["texts"][: r["copies"]], r["texts"][r["copies"] :]
        assert sum(len(t.split()) for t in r["texts"]) == r["taken"]
        assert all((r["doc_id"], r["source"], t) in given and len(t.split()) == r["size"] for t in whole)
        assert len(part) == (r["part_words"] > 0) and all(len(t.split()) == r["part_words"] for t in part)
        assert all(any(w.startswith(t) for d, s, w in given if w and (d, s) == (r["doc_id"], r["source"])) for t in part)
    assert any(0 < r["part_words"] < r["size"] for r in got) and any(not r["texts"] for r in got)
    rows = copies(take(docs)).collect()
    assert len(rows) == sum(len(r["texts"]) for r in got) and sum(len(r["text"].split()) for r in rows) == sum(r["taken"] for r in got)
    assert take(docs.limit(0)).collect() == []
