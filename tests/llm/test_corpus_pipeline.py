import random

import corpus_pipeline
from modelkeel.llm import nbsvm
from test_bottomk import brute as near_groups
from test_decontam import brute as leaks
from test_linededup import brute as line_removal

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, score int"


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(700)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 25)))
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(6)]
    rows, shared = [], [line() for _ in range(5)]
    for i in range(160):
        lines = [line() for _ in range(rng.randint(1, 8))] + ([rng.choice(shared)] if i % 3 == 0 else [])
        if i % 11 == 0:
            lines.append(rng.choice(items)[1])
        rows.append("\n".join(lines).upper() + "!!" if i % 7 == 3 else "\n".join(lines))
    for i in range(0, 60, 4):  # near copies, whose words sit in other lines so that they are not line copies
        rows.append(rows[i].replace("\n", " ").replace(" ", "\n", 1))
    rows += [rows[0], None, "", rows[4] + " more"]
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "k", i) for i, t in enumerate(rows)], items


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = spark.createDataFrame([(i, int(i % 7 != 3), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "mix":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "mix" else {r["doc_id"]: r["taken"] for r in docs.collect()}
        seen[name] = before, after

    before, after = seen["quality"]
    original = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r["doc_id"] for r in nbsvm.score(original, nbsvm.train(original, labels)).where("predicted = 1").collect()}
    assert after == {d: t for d, t in before.items() if d in good}
    assert sum(d % 7 == 3 for d in after if d < 160) <= 2 and sum(d % 7 != 3 for d in after if d < 160) >= 130

    before, after = seen["lines"]
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in before.values()], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    gone = line_removal(list(before.items()), hashes)
    assert after == {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())) for d, t in before.items()}
    assert len(gone) > 20

    before, after = seen["near_duplicates"]
    kept = {d for d, n, c, k in near_groups(list(before.items()), 80) if k}
    assert set(after) == kept and len(kept) < len(before)

    before, after = seen["decontaminate"]
    held = {d for d, *_ in leaks(list(before.items()), items, 0.8)}
    assert set(after) == set(before) - held and held

    before, after = seen["mix"]
    assert set(after) == set(before)
    words = sum(len((t or "").split()) for t in before.values())
    assert abs(sum(after.values()) / words - 1.5) < 0.05


def test_odd_rows_keep_their_columns(spark, tmp_path):
    rows = [(1, "a b c d e f", "en", None, 3, None, None), (1, "a b c d e f", "en", None, 3, None, None), (None, None, None, None, None, None, None), (2, "", "x", "s", 0, "", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, str(tmp_path)).where("doc_id IS NOT NULL").collect()) in ([(1, 9), (2, 0)], [(1, 12), (2, 0)])


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a benchmark item of a few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.collect() == [] and {"doc_id", "taken", "texts"} <= set(got.columns)
