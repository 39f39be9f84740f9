import random
import re
import zlib
from collections import Counter, defaultdict

from modelkeel.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, form int"


def words_of(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(words):
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    out = defaultdict(set)
    for group in holes.values():
        for a in group:
            for b in group:
                same = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
                longer = len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))
                if same or longer:
                    out[a].add(b)
                    out[b].add(a)
    return out


def brute(words):
    around, forms = near(words), {}
    for w, n in words.items():
        if around[w]:
            best = min(around[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * n:
                forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {w: (forms.get(w), root(w), n, len(around[w]), words.get(forms.get(w))) for w, n in words.items()}


def corpus():
    rng = random.Random(12)
    parts = ["ther", "tion", "queç", "über", "an", "al", "ñado", "e", "st", "re", "Ing"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    rows = []
    for d in range(300):
        text = []
        for _ in range(40):
            w = base[min(int(rng.expovariate(0.08)), 59)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeÿÀ") + w[i:], w[:i] + rng.choice("xy") + w[i + 1 :]]) or "x"
            text.append(w.upper() if rng.random() < 0.05 else w)
        rows.append((d, rng.choice([" ", ", ", "1"]).join(text), "w", "n", 0))
    # forms in a chain: each ten times as frequent as the one before
    chain = " ".join(["zzzzabcdefg"] * 2 + ["zzzzabcdefgh"] * 20 + ["zzzzabcdefghi"] * 200 + ["aaaaaaa"] * 3 + ["aaaaaaaa"] * 3)
    long = "y" * 3000
    return rows + [(500, chain, "", "", 0), (501, None, "", "", 0), (502, "", "", "", 0), (None, "onlyhere onlyhere twiceeee", "", "", 0),
                   (503, f"{long} {long} {long}z {long}z {long[:-1]}q {long[:-1]}q", "", "", 0), (1, rows[1][1], "", "", 0)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    words = spelling.vocabulary(docs)
    want = brute(words_of(rows))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(words).collect()}
    assert sum(x[0] is not None for x in want.values()) > 20 and want["zzzzabcdefg"][1] == "zzzzabcdefghi"
    assert got == want


def test_chosen_grams_survive_every_edit():
    """Whatever is edited, one of the two grams is cut from the edited word too, at its distance from the edge."""
    rng = random.Random(5)
    letters = "ab" * 8 + "cdé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 16))) for _ in range(300)]
    grams = Counter(w[p : p + q] for w in words for q in range(2, 6) for p in range(len(w) - q + 1))
    frequent = {g: n for g, n in grams.items() if n > 15 and all(grams[g[:q]] > 15 for q in range(2, len(g)))}
    assert any(len(g) > 3 for g in frequent)
    for w in words:
        index = {x[1:] for x in spelling.entries(w, frequent) if not x[0]}
        for i in range(len(w)):
            for other in (w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :], w[:i] + "a" + w[i + 1 :]):
                if other == w or len(other) < 4:
                    continue
                probes = {x[1:] for x in spelling.entries(w, frequent) if x[0]}
                listed = {x[1:] for x in spelling.entries(other, frequent) if not x[0]}
                assert probes & listed, (w, other)
        assert index


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(spelling.vocabulary(docs)).collect() == []
