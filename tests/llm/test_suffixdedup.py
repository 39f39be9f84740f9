import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from modelkeel.llm import suffixdedup as sd

SCHEMA = "doc_id long, text string, key long, segment string, n int"


def brute(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (d, *_), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        starts = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(t), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéf") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (38, 50, 60, 90, 300)]
    rows = []
    for _ in range(60):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                i = rng.randrange(len(p))
                p = p[:i] + "#" + p[i + 1:]
            parts += [p, text(rng.randint(0, 60))]
        rows.append(" ".join(parts))
    rows += [rows[0], rows[1][:250], None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 1000, "ab" * 300, "q" * 100 + "ab" * 150, "\x00" * 250, passages[4], passages[4][3:]]
    return [(i, t, 0, "", 1) for i, t in enumerate(rows)] + [(3, rows[3], 0, "", 1), (None, passages[1], 0, "", 1)]


def run(spark, rows):
    return sorted((tuple(r) for r in sd.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr)


def test_suffix_order():
    rng = random.Random(1)
    for alphabet in (2, 5):
        strings = [np.array([rng.randrange(alphabet) for _ in range(rng.randint(1, 30))], np.uint8) for _ in range(40)]
        owner, length = sd.transform(strings)
        got = [bytes(strings[o][len(strings[o]) - n:]) for o, n in zip(owner, length)]
        assert got == sorted(got) and sorted(zip(owner.tolist(), length.tolist())) == sorted((i, n) for i, s in enumerate(strings) for n in range(len(s) + 1))


@pytest.mark.parametrize("most", [sd.MOST, 2])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(sd, "MOST", most)
    monkeypatch.setattr(sd, "_PIECE", 3000)
    rows = corpus()
    want = brute(rows)
    assert sum(r[2] for r in want) > 5000
    assert run(spark, rows) == want


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "short", 0, "", 0)]) == [(1, 5, 0, 0, hashlib.sha256(b"short").hexdigest())]
