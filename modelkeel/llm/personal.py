"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Fixed base patterns give spans that always stay. Looser generators propose further spans, which may overlap each other:
parts of a run of digits that is too long as a whole, disguised mail addresses, dotted and bracketed numbers. Each
candidate is described by its format and by what stands around it; boosted trees score it, and a threshold per kind,
calibrated on documents that the trees did not see, decides.

There are no labelled spans, so the trees learn from what the base says for sure: a candidate that is a base span is
an example of personal data, one that fails the check of its kind (digits, Luhn sum, parts, domain) is a counter-example.
Candidates that are well-formed but no base span are what the trees have to judge.

The trees are grown from sums of gradients by feature and value, one aggregation for each level of a tree. All
candidates of the corpus are counted, none is sampled, and equal descriptions are counted together first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelkeel.session import materialise

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that no search starts inside a run it has already failed on and no
# repetition is taken back. They match what the plain patterns match, from left to right without overlaps; runs of
# fewer than 13 digits, which can be no card, are left out by the pattern.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9]){12,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)

#: Generators: kind and pattern. Each finds spans without overlaps; those of different generators may overlap.
GENERATORS = (
    (0, r"(?<![^\s<>()\[\],;:\"'])[^\s<>()\[\],;:\"'@]++@[^\s<>()\[\],;:\"'@]*+(?<=[A-Za-z0-9])"),
    (0, rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\(at\)|\[at\]|\{{at\}}) ?{_LABEL}++(?: ?(?:\(dot\)|\[dot\]|\{{dot\}}|\.) ?{_LABEL}++)++"),
    (1, r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,7}+(?!\.?[0-9])"),
    (1, r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{12,20}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{4}([ ./_-])[0-9]{6}\1[0-9]{4,5}(?![0-9])"),
    (3, r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})[ .-]?[0-9]{2,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    (3, r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    (3, r"(?<![0-9+])(?:\+|00)(?=[0-9][0-9 .()-]{5,}[0-9])[0-9]{1,7}(?:[ .()-]{1,2}[0-9]{1,7}){0,5}(?![0-9])"),
)
#: What a text must hold for any of a kind's patterns to match: cheap tests that spare most texts the patterns.
_NUMBERS = r"[0-9][0-9 ().\[\]/_-]{5,}[0-9]"
_AT = ("@", "at)", "at]", "at}")
#: Words before a span that speak for personal data, lower case.
CUES = r"(?i)(?:mail|e-mail|contact|tel|phone|call|fax|mobile|cell|card|visa|ip|host|addr|address|from)[\s:.#=]{0,3}$"
#: What precedes a span, as far as it is looked at.
CONTEXT = 16

FEATURES = ("kind", "generator", "digits", "marks", "dots", "before", "after", "plus", "luhn", "lead", "octets", "cue")
ROUNDS, DEPTH, RATE, RIDGE = 6, 3, 0.5, 1.0
#: Share of right ones that a threshold must reach on documents kept back, and the fold that is kept back.
PRECISION, FOLDS = 0.95, 5
#: Nothing overlaps more added spans of its kind than this on either side: they are short, and each generator's do not overlap.
NEIGHBOURS = 30

_BLOCK = 256
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _ends(sizes: Column) -> Column:
    """Running sums of an array, by blocks, so that the work stays near its length."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / _BLOCK).cast("int")), lambda b: total(F.slice(sizes, b * _BLOCK + 1, _BLOCK)))
    bases = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.struct(sizes.alias("sizes"), bases.alias("bases"))


def _start(ends: Column, i: Column) -> Column:
    """What the sizes before place ``i`` add up to."""
    block = F.floor(i / _BLOCK).cast("int")
    inside = F.aggregate(F.slice(ends["sizes"], block * _BLOCK + 1, i - block * _BLOCK), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.get(ends["bases"], block) + inside


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of a text, the number ``g`` of a pattern and all its matches ``m``, as one row a match.

    ``s`` and ``e`` are places in code points, ``before`` and ``after`` what stands around. They follow from the sizes
    of the matches and of the text between them. Each step is a projection of its own, so that none of it is computed
    once for each match.
    """
    patterns = F.array(*[F.lit(p) for p in (*BASE, *(p for _, p in GENERATORS))])
    cut = rows.withColumn("p", F.split("text", F.get(patterns, F.greatest("g", F.lit(0))), -1)).drop("text")
    sizes = F.transform(F.arrays_zip(F.col("p").alias("p"), F.col("m").alias("m")), lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
    previous = F.concat(F.array(F.lit("")), F.slice("m", 1, F.size("m") - 1))
    around = F.arrays_zip(F.col("m").alias("m"), F.slice("p", 1, F.size("m")).alias("p"), F.slice("p", 2, F.size("m")).alias("n"), previous.alias("q"))
    sized = cut.withColumn("sizes", sizes).withColumn("ends", _ends(F.col("sizes"))).withColumn("around", around)
    one = sized.select("doc_id", "th", "g", "ends", F.posexplode("around").alias("i", "x"))
    before = F.when(F.col("x.p") != "", F.right("x.p", F.lit(CONTEXT))).otherwise(F.right("x.q", F.lit(1)))
    e = _start(F.col("ends"), F.col("i") + 1)
    return one.select("doc_id", "th", "g", (e - F.length("x.m")).alias("s"), e.alias("e"), F.col("x.m").alias("m"), before.alias("before"), F.left("x.n", F.lit(1)).alias("after"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _well_formed(kind: int, text: Column) -> Column:
    """The check of a kind, as the base makes it; separators are those of the candidate."""
    n = F.length(_digits(text))
    if kind == 0:
        return F.rlike(text, F.lit(r"[A-Za-z0-9](?:@|[({\[]at[)}\]]).*(?:\.|[({\[]dot[)}\]]) ?[A-Za-z0-9-]"))
    if kind == 1:
        plain = F.regexp_replace(text, r"[\[\]()]", "")
        return F.rlike(plain, F.lit(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"))
    if kind == 2:
        return n.between(13, 19) & F.call_function("luhn_check", _digits(text))
    return n.between(9, 15)


def _passes(kind: Column, text: Column) -> Column:
    """The check of the kind that a row is of."""
    return F.coalesce(reduce(lambda a, k: a.when(kind == k, _well_formed(k, text)), range(1, len(KINDS)), F.when(kind == 0, _well_formed(0, text))), F.lit(False))


def _class(char: Column) -> Column:
    """Nothing or blank 0, letter 1, digit 2, quote 3, equals sign or slash 4, anything else 5."""
    kinds = (("^$|^\\s$", 0), ("^\\p{L}$", 1), ("^[0-9]$", 2), ("^[\"'`]$", 3), ("^[=/\\\\&?#]$", 4))
    return F.coalesce(*[F.when(F.rlike(char, F.lit(p)), F.lit(v)) for p, v in kinds], F.lit(5))


def _described(rows: DataFrame) -> DataFrame:
    """Candidates with the features of their format and context, all small whole numbers, and ``good``."""
    text, digits = F.col("m"), _digits(F.col("m"))
    n, bounded = F.length(digits), lambda x, top: F.least(x, F.lit(top)).cast("int")
    generator = F.col("g") - len(BASE)
    kind = F.get(F.array(*[F.lit(k) for k, _ in GENERATORS]), generator)
    return rows.select(
        "doc_id", "th", "s", "e", kind.alias("kind"), generator.alias("generator"), _passes(kind, text).alias("good"),
        bounded(n, 21).alias("digits"), bounded(F.length(F.regexp_replace(text, "[^ ()\\[\\]/_-]", "")), 6).alias("marks"),
        bounded(F.length(F.regexp_replace(text, "[^.]", "")), 6).alias("dots"), _class(F.right("before", F.lit(1))).alias("before"),
        _class(F.col("after")).alias("after"), F.startswith(text, F.lit("+")).cast("int").alias("plus"),
        F.coalesce(F.call_function("luhn_check", F.when(n.between(12, 20), digits)), F.lit(False)).cast("int").alias("luhn"),
        F.when(n > 0, F.left(digits, F.lit(1)).cast("int")).otherwise(10).alias("lead"),
        F.coalesce(_well_formed(1, text), F.lit(False)).cast("int").alias("octets"), F.rlike("before", F.lit(CUES)).cast("int").alias("cue"),
    )


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, th, g, s, e, m, before, after``: from one reading of the texts, every match of every pattern.

    ``th`` is the hash of the text and ``g`` the number of the pattern, the base ones first; a row of each document with
    ``g`` of -1 stands for itself.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    has_at = reduce(lambda a, b: a | b, [F.contains("text", F.lit(x)) for x in _AT])
    gated = texts.select("*", has_at.alias("at"), F.rlike("text", F.lit(_NUMBERS)).alias("numbers"))

    def matches(kind: int, pattern: str) -> Column:
        return F.when(F.col("numbers" if kind else "at"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))

    numbered = enumerate((*enumerate(BASE), *GENERATORS))
    found = F.array(F.struct(F.lit(-1).alias("g"), F.array(F.lit("")).alias("m")),
                    *[F.struct(F.lit(g).alias("g"), matches(k, p).alias("m")) for g, (k, p) in numbered])
    rows = gated.withColumn("found", F.filter(found, lambda x: F.size(x["m"]) > 0))
    # the outer form, as a filter inferred from the other one would search every text twice
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "text", F.inline_outer("found"))
    rows = rows.withColumn("text", F.when(F.col("g") >= 0, F.col("text")).otherwise(""))
    return _placed(rows)


def base_spans(found: DataFrame) -> DataFrame:
    """``doc_id, th, k, s, e`` of the base spans; rows equal in id and text have them once."""
    passed = found.where(F.col("g").between(0, len(BASE) - 1) & ((F.col("g") == 0) | _passes(F.col("g"), F.col("m"))))
    return passed.select("doc_id", "th", F.col("g").alias("k"), "s", "e").distinct()


def candidates(found: DataFrame) -> DataFrame:
    """Candidates, described, with ``label``: 1 a base span, 0 fails its check, null is to be judged.

    Other candidates that overlap a base span are left out: the base stays as it is. Whether one does follows from the
    largest end of the base spans that begin no later and the next start, in running windows over a document's spans.
    """
    key = ["doc_id", "th"]
    proposed = _described(found.where(F.col("g") >= len(BASE)).dropDuplicates([*key, "g", "s"]))
    base = base_spans(found)
    # a base span as a row among the candidates; documents without any candidate are not needed
    marks = proposed.unionByName(base.select(*key, "k", "s", "e", F.col("e").alias("base_e")), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("s")
    reached = F.max("base_e").over(order.rangeBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(F.col("base_e").isNotNull(), F.col("s"))).over(order.rangeBetween(1, Window.unboundedFollowing))
    here = Window.partitionBy(*key, "s", "e")
    is_base = F.array_contains(F.collect_set("k").over(here), F.col("kind"))
    seen = marks.select("*", reached.alias("reached"), following.alias("following"), is_base.alias("is_base")).where("generator IS NOT NULL")
    apart = (F.coalesce("reached", F.lit(-1)) <= F.col("s")) & (F.coalesce(F.col("following") >= F.col("e"), F.lit(True)))
    label = F.when(F.col("is_base"), F.lit(1)).when(~F.col("good"), F.lit(0))
    return seen.where(F.col("is_base") | apart).select(*key, "s", "e", *FEATURES, label.alias("label"))


def _score(trees: list[dict]) -> Column:
    """Sum of the trees' leaf values, as one expression."""
    def walk(node: dict) -> Column:
        if "value" in node:
            return F.lit(float(node["value"]))
        return F.when(F.col(node["feature"]) <= node["at"], walk(node["low"])).otherwise(walk(node["high"]))

    return reduce(lambda a, t: a + walk(t), trees, F.lit(0.0))


def _leaf(node: dict, path: tuple = ()) -> Column:
    """Number of the open node a row falls into, by the path of its turns."""
    if "feature" not in node:
        return F.lit(path_number(path))
    return F.when(F.col(node["feature"]) <= node["at"], _leaf(node["low"], (*path, 0))).otherwise(_leaf(node["high"], (*path, 1)))


def path_number(path: tuple) -> int:
    return reduce(lambda a, b: 2 * a + b, path, 1)


def _best_splits(rows: DataFrame) -> dict[int, dict]:
    """For each node, the feature and bound that lower the loss most, and the leaf values of both sides.

    One aggregation gives the sums of gradients by node, feature and value, a few hundred rows whatever the number
    of candidates. Running sums over a feature's values then give every bound.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("int").alias("at")) for i, f in enumerate(FEATURES)])
    sums = rows.select("node", "g", "h", F.inline(cells)).groupBy("node", "feature", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    by_node: dict[int, list] = {}
    for r in sorted(sums.collect()):
        by_node.setdefault(r["node"], []).append(r)
    return {node: _best_of(rs) for node, rs in by_node.items()}


def _best_of(sums: list) -> dict:
    """The best split of one node from its sums in order; ties go to the first feature and bound."""
    gain = lambda g, h: g * g / (h + RIDGE)
    value = lambda g, h: RATE * g / (h + RIDGE)
    all_g, all_h = (sum(r[c] for r in sums if r["feature"] == 0) for c in "gh")
    best, g, h, feature = {"gain": 0.0}, 0.0, 0.0, -1
    for r in sums:
        if r["feature"] != feature:
            g, h, feature = 0.0, 0.0, r["feature"]
        g, h = g + r["g"], h + r["h"]
        more = round(gain(g, h) + gain(all_g - g, all_h - h) - gain(all_g, all_h), 6)
        if more > best["gain"]:
            best = {"gain": more, "feature": FEATURES[feature], "at": r["at"], "low": value(g, h), "high": value(all_g - g, all_h - h)}
    return best | {"own": value(all_g, all_h)}


def grow(cells: DataFrame) -> list[dict]:
    """Boosted trees of log loss on ``cells``: FEATURES, ``label`` and weight ``n``. No cell gives no tree."""
    trees: list[dict] = []
    for _ in range(ROUNDS):
        p, n = F.col("p"), F.col("n")
        scored = cells.withColumn("p", 1 / (1 + F.exp(-_score(trees))))
        weighted = scored.select(*FEATURES, ((F.col("label") - p) * n).alias("g"), (p * (1 - p) * n).alias("h"))
        root: dict = {}
        open_nodes = {1: root}
        for _level in range(DEPTH):
            best = _best_splits(weighted.withColumn("node", _leaf(root)))
            following = {}
            for number, node in sorted(open_nodes.items()):
                if number not in best:
                    continue
                b = best[number]
                node["own"] = b["own"]
                if b["gain"] > 0:
                    node |= {"feature": b["feature"], "at": b["at"], "low": {"own": b["low"]}, "high": {"own": b["high"]}}
                    following |= {2 * number: node["low"], 2 * number + 1: node["high"]}
            open_nodes = following
            if not following:
                break
        if "own" not in root:
            break
        trees.append(_closed(root))
    return trees


def _closed(node: dict) -> dict:
    if "feature" in node:
        return {"feature": node["feature"], "at": node["at"], "low": _closed(node["low"]), "high": _closed(node["high"])}
    return {"value": node["own"]}


def thresholds(cells: DataFrame, trees: list[dict]) -> dict[int, float]:
    """For each kind, the least score from which on at least PRECISION of the candidates are right (one wrong one is added).

    A kind without examples gets none, and no span is added to it. The scores are as many as leaf sums.
    """
    steps = cells.groupBy("kind", F.round(_score(trees), 6).alias("score")).agg(F.sum(F.col("n") * F.col("label")).alias("right"), F.sum("n").alias("n"))
    down = Window.partitionBy("kind").orderBy(F.desc("score"))
    held = steps.select("kind", "score", (F.sum("right").over(down) / (F.sum("n").over(down) + 1)).alias("precision"))
    return {r["kind"]: r["score"] for r in held.where(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("score").alias("score")).collect()}


def train(proposed: DataFrame) -> tuple[list[dict], dict[int, float]]:
    """Trees and thresholds from candidate rows; a fifth of the documents, by crc32 of the id, only calibrates."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    counted = proposed.where("label IS NOT NULL").groupBy(*FEATURES, "label", (fold == 0).alias("held")).agg(F.count(F.lit(1)).alias("n"))
    cells = materialise(counted.coalesce(8), "personal-cells")
    trees = grow(cells.where("NOT held"))
    return trees, thresholds(cells.where("held"), trees)


def redactions(proposed: DataFrame, trees: list[dict], limits: dict[int, float]) -> DataFrame:
    """``doc_id, th, k, s, e, score`` of the spans that are added: judged candidates from the threshold of their kind on.

    Of overlapping ones the one that a better one overlaps goes; better is the higher score, then the longer, the
    earlier, the first generator.
    """
    limit = reduce(lambda a, kv: a.when(F.col("kind") == kv[0], F.lit(float(kv[1]))), limits.items(), F.when(F.lit(False), F.lit(0.0)))
    scored = proposed.where("label IS NULL").select("doc_id", "th", "kind", "s", "e", "generator", F.round(_score(trees), 6).alias("score"))
    scored = scored.where(F.col("score") >= limit)
    rank = F.struct(-F.col("score"), F.col("s") - F.col("e"), F.col("s"), F.col("generator"))
    near = Window.partitionBy("doc_id", "th", "kind").orderBy("s", "e", "generator").rowsBetween(-NEIGHBOURS, NEIGHBOURS)
    around = scored.select("*", rank.alias("rank")).withColumn("around", F.collect_list(F.struct("s", "e", "rank")).over(near))
    beaten = F.exists("around", lambda o: (o["rank"] < F.col("rank")) & (o["s"] < F.col("e")) & (o["e"] > F.col("s")))
    return around.where(~beaten).select("doc_id", "th", F.col("kind").alias("k"), "s", "e", "score")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, th, base, spans`` of every row of ``docs``: arrays of structs of kind number ``k``, ``s`` and ``e``.

    A null text is empty; an empty text has no spans. Rows equal in id and text get equal spans, a null id is an id of
    its own; other columns are not looked at. An empty table gives no row. Texts of any length are one row each;
    the work grows with their length and the number of their spans. ``th`` is the hash of the text.
    """
    found = materialise(find(docs), "personal-found")
    proposed = materialise(candidates(found), "personal-candidates")
    added = redactions(proposed, *train(proposed)).withColumn("added", F.lit(True))
    spans = base_spans(found).withColumn("added", F.lit(False)).unionByName(added.drop("score"))
    span, key = F.struct("k", "s", "e"), [F.col("doc_id").alias("sd"), F.col("th").alias("st")]
    by_row = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(~F.col("added"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    rows = found.where("g = -1").select("doc_id", "th")
    joined = rows.join(by_row, F.col("doc_id").eqNullSafe(F.col("sd")) & (F.col("th") == F.col("st")), "left")
    none = F.array().cast("array<struct<k:int,s:bigint,e:bigint>>")
    return joined.select("doc_id", "th", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, mask: str = "*") -> DataFrame:
    """``docs``, all their rows and columns, with every span of a text replaced by one ``mask``; spans that overlap by one.

    Nulls, ties, repeated rows and empty tables are as for :func:`personal_data`; a null text stays null.
    """
    spans = personal_data(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "th"])
    spans = spans.select(F.col("doc_id").alias("_rd"), F.col("th").alias("_rt"), F.array_sort(F.transform("spans", lambda x: F.struct(x["s"], x["e"]))).alias("_spans"))
    text = F.col("d.text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        piece = F.substring(text, (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int"))
        out = F.when(x["s"] >= a["at"], F.concat(a["out"], F.array(piece, F.lit(mask)))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), out.alias("out"))

    joined = docs.alias("d").join(spans, F.col("d.doc_id").eqNullSafe(F.col("_rd")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_rt")), "left")
    cut = joined.withColumn("_m", F.when(F.col("_spans").isNotNull(), F.aggregate("_spans", start, step)))
    masked = F.concat(F.array_join("_m.out", ""), F.substring(text, (F.col("_m.at") + 1).cast("int"), F.length(text)))
    return cut.select(*[F.coalesce(masked, text).alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, the numbers of base spans by kind, their digest, all spans, and how many of them were added."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
