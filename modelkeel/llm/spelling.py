"""Words that differ by one code point, by an index of grams of variable length.

A gram of two code points is lengthened while it is frequent in the vocabulary, so that common beginnings give longer grams
and no list of words gets long. A word is cut into the grams that begin at its places, without those that lie inside
an earlier one. One edit can change only grams near it: those that begin before it and could reach it at their
greatest length, and those behind it that a changed one could cover. The others keep their distance from the start of
the word, if the edit is behind them, or from its end. For each word two grams are chosen of which every edit leaves
one whole: the lists of these two, at their distances, hold all near words. Merging reads no other list; what they
hold is verified by edit distance.

The greatest length is half the length of the shorter word (of two to six code points), so that such a pair of
grams exists for every word of at least four. A pair of words of different length is found by the longer one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeel.session import materialise, spread

SHORTEST_GRAM, LONGEST_GRAM = 2, 6
#: Fewer grams of each length than this are lengthened, as those are the ones above 1/FREQUENT of all: the bound of what tasks get.
FREQUENT = 20_000
RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO, EDITED = 7, 2, 10, 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIDES = ("left", "right")


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all whole texts, some with one code point deleted by their hash, and how often they occur.

    A null text has no word, a null doc_id is an empty one in the hash; repeated rows count each time.
    """
    # shorter runs can be no word, as nothing lengthens them
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.left("run", at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % EDITED == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The grams that are lengthened, with their counts over distinct words; fewer than FREQUENT of each length.

    A gram is above the bound only if all its beginnings are.
    """
    lengths = F.sequence(F.lit(SHORTEST_GRAM), F.lit(LONGEST_GRAM - 1))
    starts = F.sequence(F.lit(1), F.length("word") - SHORTEST_GRAM + 1)
    grams = words.select("word", F.explode(starts).alias("at")).select("word", "at", F.explode(lengths).alias("q"))
    grams = grams.where(F.col("at") + F.col("q") - 1 <= F.length("word")).select(F.substr("word", F.col("at"), F.col("q")).alias("gram"))
    total = words.agg(F.coalesce(F.sum(F.length("word") - SHORTEST_GRAM + 1), F.lit(0)).alias("n")).first()["n"]
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > total / FREQUENT)
    return {r["gram"]: r["n"] for r in counted.collect()}


def cut(word: str, longest: int, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """Grams of a word as (start, end): lengthened while frequent, without those inside an earlier one."""
    out, reached = [], 0
    for p in range(len(word) - SHORTEST_GRAM + 1):
        e = p + SHORTEST_GRAM
        while e - p < longest and e < len(word) and word[p:e] in frequent:
            e += 1
        if e > reached:
            out.append((p, e))
            reached = e
    return out


def chosen(grams: list[tuple[int, int]], word: str, longest: int, frequent: dict[str, int]) -> tuple[tuple[int, int], tuple[int, int]]:
    """A gram that edits from ``p + longest`` on leave whole, and one that edits before ``e - longest`` do, which together leave none out.

    The pair with the shortest lists by the counts known; ties go to the longer grams.
    """
    def cost(g: tuple[int, int]) -> tuple[int, int]:
        return frequent.get(word[g[0] : g[1]], 0), g[0] - g[1]

    best = None
    for left in grams:
        for right in reversed(grams):
            if left[0] + longest > right[1] - longest:
                break
            score = (max(cost(left), cost(right)), min(cost(left), cost(right)))
            if best is None or score < best[0]:
                best = score, left, right
    return best[1], best[2]


def longest_for(length: int) -> int:
    """Greatest gram length for pairs whose shorter word has this length."""
    return max(SHORTEST_GRAM, min(LONGEST_GRAM, length // 2))


def entries(word: str, frequent: dict[str, int]) -> Iterator[tuple[bool, int, int, int, str]]:
    """Index entries and probes of a word: whether a probe, length of the shorter word, side, distance, gram.

    The index holds the grams that a word as long, or one longer, could choose.
    """
    size = len(word)
    for shorter in (size, size - 1):
        if shorter < 2 * SHORTEST_GRAM:
            continue
        longest = longest_for(shorter)
        grams = cut(word, longest, frequent)
        if shorter == size:
            for p, e in grams:
                if p <= size + 1 - 2 * longest:
                    yield False, shorter, 0, p, word[p:e]
                if size - e <= size + 1 - 2 * longest:
                    yield False, shorter, 1, size - e, word[p:e]
        left, right = chosen(grams, word, longest, frequent)
        yield True, shorter, 0, left[0], word[left[0] : left[1]]
        yield True, shorter, 1, size - right[1], word[right[0] : right[1]]


_ENTRY = "word string, n long, probe boolean, shorter int, side int, distance int, gram string"


def gram_entries(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """The entries of all words; the frequent grams go to the tasks as a broadcast of bounded size."""
    known = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = [(w, n, *x) for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x in entries(w, known.value)]
                kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n", "probe", "shorter", "side", "distance", "gram"])

    return spread(words.select("word", "n")).mapInArrow(run, _ENTRY)


def _signature(word: Column) -> Column:
    """One bit flipped for each code point: near words differ in two bits at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(bit(c)))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, an, b, bn``: every pair of distinct ``words`` (word, n) one inserted, deleted or replaced code point apart, once.

    ``a`` is the longer one, of equal lengths the greater. Words of fewer than four code points are not looked at.
    """
    listed = materialise(gram_entries(words, frequent_grams(words)), "spelling-grams")
    key = ["shorter", "side", "distance", "gram"]
    listed = listed.select(*key, "probe", "word", "n", _signature(F.col("word")).alias("sig"))
    probes, index = listed.where("probe").drop("probe"), listed.where("NOT probe").drop("probe")
    p, i = probes.alias("p"), index.alias("i")
    size = lambda side: F.length(f"{side}.word")
    meets = reduce_and([F.col(f"p.{k}") == F.col(f"i.{k}") for k in key])
    later = (size("p") > size("i")) | (F.col("p.word") > F.col("i.word"))
    alike = F.bit_count(F.col("p.sig").bitwiseXOR(F.col("i.sig"))) <= 2
    near = F.levenshtein(F.col("p.word"), F.col("i.word"), 1) == 1
    joined = p.join(i, meets & later & alike & near)
    return joined.select(F.col("p.word").alias("a"), F.col("p.n").alias("an"), F.col("i.word").alias("b"), F.col("i.n").alias("bn")).distinct()


def reduce_and(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form: where the forms lead. ``forms`` (word, form) has no circles.

    Each round doubles how far a row looks, so the rounds are as many as the doublings of the longest way.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        joined = materialise(now.join(on, F.col("root") == F.col("w"), "left").select("word", "root", "further"), "spelling-roots")
        if joined.where("further IS NOT NULL").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", F.coalesce("further", "root").alias("root"))


def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all ``words`` (word, n).

    The form of a word is its near word of largest ``n``, of equal ones the first in code-point order, if it occurs
    at least ten times as often. An empty table gives no row. Words of any length are one row each.
    """
    pairs = materialise(near_pairs(words), "spelling-pairs")
    ways = pairs.select(F.col("a").alias("w"), F.struct((-F.col("bn")).alias("m"), F.col("b").alias("form")).alias("o")).unionByName(
        pairs.select(F.col("b").alias("w"), F.struct((-F.col("an")).alias("m"), F.col("a").alias("form")).alias("o")))
    around = ways.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min("o").alias("o"))
    best = -F.col("o.m")
    follows = best >= RATIO * F.col("n")
    joined = words.join(around, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, F.col("o.form")).alias("form"), F.when(follows, best).alias("form_n"))
    joined = materialise(joined, "spelling-forms")
    led = roots(joined.where("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "r")
    out = joined.join(led, F.col("word") == F.col("r"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of all documents."""
    words = materialise(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")), "spelling-words")
    return variants(words)
