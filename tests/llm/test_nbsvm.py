import random
import tracemalloc
import zlib

import numpy as np

from modelkeel.llm import hashing, nbsvm

DOCS = "doc_id long, text string, score string, label int, held string"
LABELS = "doc_id long, quality int, toxic int"


def data(n=400):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice("the of and river stone house walks under a bright sky".split()) for _ in range(30))
    bad = [lambda: good().upper() + "!!", lambda: " ".join([rng.choice(["buy", "now", "the"])] * 25), lambda: good().replace(" ", " | ")]
    return [(i, good() if i % 3 else bad[i // 3 % 3](), "x", 7, "y") for i in range(n)]


def test_mark_repeats():
    mark = lambda t: nbsvm.mark_repeats(np.frombuffer(t.encode(), np.uint8)).tobytes().decode()
    assert mark("the The  the dog a a") == "the \x01  \x01 dog a \x01"
    assert mark("") == "" and mark(" é é") == " é \x01"


def test_slots_are_the_ngrams():
    text = ("é ab ab c " * 3).encode()
    scratch = np.zeros(1 << nbsvm.BITS, bool)
    got = set(nbsvm.slots(np.frombuffer(text, np.uint8), scratch).tolist())
    marked = nbsvm.mark_repeats(np.frombuffer(text, np.uint8)).tobytes()
    want = {((int.from_bytes(marked[i:i + n], "little") + (n << 40)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - nbsvm.BITS)
            for n in nbsvm.SIZES for i in range(len(marked) - n + 1)}
    assert got == want and not scratch.any()


def test_held_out_accuracy_and_odd_rows(spark):
    rows = data()
    docs = spark.createDataFrame(rows + [(900, None, "", 0, ""), (900, None, "", 0, ""), (None, "", "", 0, ""), (901, "x" * 3_000_000, "", 0, "")], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(1, None, 0), (2, 9, 0), (None, 1, 0)], LABELS)
    model = nbsvm.train(docs, labels)
    got = [r.asDict() for r in nbsvm.score(docs, model).collect()]
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(400))
    out = [i for i in range(400) if by[i]["held_out"]]
    assert sum(by[i]["predicted"] == (i % 3 > 0) for i in out) / len(out) > 0.97
    kept = nbsvm.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"] in range(400)} == {i for i in range(400) if by[i]["predicted"]}
    # held-out labels teach nothing
    turned = labels.withColumn("quality", __import__("pyspark").sql.functions.expr("CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END"))
    assert np.array_equal(nbsvm.train(docs, turned).weight, model.weight)


def test_no_rows_and_one_class(spark):
    none = spark.createDataFrame([], DOCS)
    model = nbsvm.train(none, spark.createDataFrame([], LABELS))
    assert nbsvm.score(none, model).collect() == []
    docs = spark.createDataFrame(data(30), DOCS)
    one = nbsvm.train(docs, spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS))
    assert {r["predicted"] for r in nbsvm.score(docs, one).collect()} == {1}


def test_fit_against_the_primal_optimum():
    """The dual coordinate descent reaches the least hinge loss that subgradient steps find on scaled indicators."""
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 60)
    texts = [np.unique(np.concatenate([rng.choice(40, 8), rng.choice(15, 4) + (40 if y else 50)])) for y in labels]
    flat, cuts = np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)])
    model = nbsvm.fit(flat, cuts, labels, epochs=2000)
    # log-count ratios by counting
    n_slots = 1 << nbsvm.BITS
    counts = {y: np.ones(n_slots) for y in (0, 1)}
    for t, y in zip(texts, labels):
        for slot in t:
            counts[y][slot] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    assert np.allclose(model.ratio, ratio, atol=1e-6)
    x = np.zeros((60, 66))
    for i, t in enumerate(texts):
        x[i, t] = ratio[t] / np.linalg.norm(ratio[t])
    x[:, -1], y = 1, np.where(labels == 1, 1.0, -1.0)

    def loss(w):
        return w @ w / 2 + np.maximum(1 - y * (x @ w), 0).sum()

    w, best = np.zeros(66), np.inf
    for step in range(1, 20001):
        w = w - (w - x.T @ (y * (y * (x @ w) < 1))) / step
        best = min(best, loss(w))
    got = np.append(model.weight[:65], model.weight[-1]).astype(float)
    assert not model.weight[65:-1].any()
    # the descent stops once no step moves more than a thousandth
    assert abs(loss(got) - best) <= 1e-3 * best


def test_word_hashes_in_small_pieces(monkeypatch):
    words = ["a", "Bc", "é" * 40, "q" * 3_000, "w" * 900, "end"] * 400
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = hashing.word_bounds(data, np.array([0, len(data)]))
    hashing._powers.cache_clear()
    tracemalloc.start()
    whole = hashing.word_hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the tables of powers took 67 MB while they were made and 34 MB after it
    assert peak < 24e6
    monkeypatch.setattr(hashing, "_PIECE", 1000)
    hashing._powers.cache_clear()
    assert (hashing.word_hashes(data, starts, ends) == whole).all() and len(set(whole.tolist())) == 6
    hashing._powers.cache_clear()
