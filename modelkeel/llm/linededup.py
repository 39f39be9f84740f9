"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its words, in lower case. Its words are ordered by rarity, and two lines whose sets have a Jaccard similarity
of at least 4/5 share a word among the first few of each (prefix filter). Such pairs must also fit in length, in the
places of the shared word (positional filter), and in a parity signature of 64 or 128 bits whose differing bits
cannot outnumber the differing words. Whole sets decide what is left.

Words are 64-bit hashes whose first 16 bits, the slot, are replaced by the slot's place in the order of word counts,
so sorting the numbers of a line sorts its words by rarity and no two hashes become one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelkeel.session import materialise

SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
#: Sets of more words have a signature of 128 bits, others one of 64.
LONG_SET = 96
SEPARATORS = " \t\n\v\f\r"
#: Least and greatest number of bits of the filter that keeps lines without a candidate out of the join for verification.
FILTER_BITS, MOST_FILTER_BITS = 1 << 16, 1 << 27


def _words(line: Column, then=lambda t: t) -> Column:
    """The words of a line, or of what ``then`` makes of a text, with empty ones between separators that follow each other.

    Separators other than blanks are rare, so they are only replaced where there are some, and cutting at blanks is the cheap way.
    """
    blank, others, text = SEPARATORS[0], SEPARATORS.replace("\n", "")[1:], line
    for mark in others:
        text = F.replace(text, F.lit(mark), F.lit(blank))
    return F.split(F.lower(then(F.when(line.rlike(f"[{others}]"), text).otherwise(line))), blank)


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - SLOT_BITS)


def _dense(numbers: DataFrame, order: list[str], value: str) -> Column:
    """The column ``value`` of a table of bounded size as one array in the given order, for look-ups by place.

    It is a scalar subquery on a written row: the numbers appear in no plan and pass no Python code.
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, value)))
    row = materialise(numbers.agg(F.transform(rows, lambda r: r[value]).alias("values")), "line-numbers")
    return row.scalar()


def slot_ranks(docs: DataFrame) -> Column:
    """For each slot the bits that turn it into its place in the order of how many words of all texts fall into it, at their place in a hash.

    Places begin below zero, as the first bit of a number is its sign.
    """
    # no text is cut into nothing; an inner explode would have all texts cut once more to see that
    words = docs.where("text IS NOT NULL").select(F.explode_outer(_words(F.col("text"), lambda t: F.replace(t, F.lit("\n"), F.lit(" ")))).alias("w")).where("w <> ''")
    counts = words.groupBy(_slot(F.xxhash64("w")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(SLOTS).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("n"))
    counts = counts.unionByName(every).groupBy("slot").agg(F.sum("n").alias("n"))
    # one task, but never more than SLOTS rows
    places = counts.withColumn("place", (F.row_number().over(Window.orderBy("n", "slot")) - 1 - SLOTS // 2).cast("long"))
    flips = F.shiftleft(F.col("place").bitwiseXOR(F.col("slot")), 64 - SLOT_BITS)
    return _dense(places.select("slot", flips.alias("flips")), ["slot"], "flips")


def _lines(docs: DataFrame) -> DataFrame:
    """All lines: where they stand, and their text."""
    # hashed and cut below the explode, so that no line carries its whole text
    cut = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))
    # no text is cut into nothing; an inner explode would have all texts cut once more to see that
    cut = cut.select("doc_id", "th", F.posexplode_outer("lines").alias("line", "text"))
    return cut.select(F.struct("doc_id", "th", "line").alias("at"), "text")


def _word_sets(lines: DataFrame, ranks: Column) -> DataFrame:
    """Lines, their other columns and their sets as sorted word numbers; a line without words has an empty one."""
    ranked, ranks, none = lines.withColumn("ranks", ranks), F.col("ranks"), F.lit(0).cast("long")

    def number(h: Column) -> Column:
        # every slot has a place; said to be never null, the numbers are sorted as plain longs
        return F.coalesce(h.bitwiseXOR(F.get(ranks, _slot(h).cast("int"))), none)

    # a word is hashed once, and only the distinct ones are numbered
    hashes = F.array_distinct(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)))
    ids = F.sort_array(F.transform(F.array_remove(hashes, F.xxhash64(F.lit(""))), number))
    return ranked.select(*[c for c in lines.columns if c != "text"], ids.alias("ids"))


def _sets(lines: DataFrame, ranks: Column) -> DataFrame:
    """Lines: sets, and their size, key and two signatures, which together name the set."""
    none, long_set = F.lit(0).cast("long"), F.size("ids") > LONG_SET

    def parity(flips) -> Column:
        # a number flips the bit of its last six bits
        return F.aggregate("ids", none, lambda a, x: a.bitwiseXOR(flips(x)))

    def half(which: int) -> Column:
        return parity(lambda x: F.when(x.bitwiseAND(F.lit(64)) == 64 * which, _bit(x)).otherwise(none))

    sets = _word_sets(lines, ranks)
    sig, sig2 = F.when(long_set, half(0)).otherwise(parity(_bit)), F.when(long_set, half(1)).otherwise(none)
    return sets.select("at", "ids", F.size("ids").alias("n"), F.xxhash64("ids").alias("key"), sig.alias("sig"), sig2.alias("sig2"))


def _bit(number: Column) -> Column:
    """A long with the bit of the number's last six bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))


def _least_common(a: Column, b: Column) -> Column:
    """Words two sets of these sizes must share for a similarity of 4/5."""
    return F.ceil((a + b) * 4 / F.lit(9))


def _fits(x: str, y: str) -> Column:
    """Whether two entries of a word can belong to alike sets: by length, place of the word, and signature."""
    xn, yn = (F.shiftright(f"{side}.size", 32).cast("int") for side in (x, y))
    xp, yp = (F.col(f"{side}.size").bitwiseAND(F.lit((1 << 31) - 1)).cast("int") for side in (x, y))
    need = _least_common(xn, yn)
    # a short set has one signature, a long one two halves of it, which make one again
    both = (xn > LONG_SET) == (yn > LONG_SET)
    apart = sum(F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("sig", "sig2"))
    one = [F.col(f"{side}.sig").bitwiseXOR(F.col(f"{side}.sig2")) for side in (x, y)]
    return (
        (F.col(f"{x}.word") == F.col(f"{y}.word"))
        & (F.least(xn, yn) * 5 >= F.greatest(xn, yn) * 4)
        & (F.least(xn - xp, yn - yp) * 9 >= (xn + yn) * 4)
        & (F.when(both, apart).otherwise(F.bit_count(one[0].bitwiseXOR(one[1]))) <= xn + yn - 2 * need)
    )


def _whole_sets(docs: DataFrame, ranks: Column, wanted: DataFrame) -> DataFrame:
    """``sid, ids`` of the wanted sets (``sid, at``), taken once more from the texts.

    A bit filter on places of lines, sized by the number of wanted sets up to MOST_FILTER_BITS, keeps other lines out
    of the join; a full one would only let more lines through.
    """
    bits = max(FILTER_BITS, min(MOST_FILTER_BITS, 1 << (16 * wanted.count()).bit_length()))
    place = F.xxhash64("at").bitwiseAND(F.lit(bits - 1))
    filled = wanted.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(_bit(place)).alias("bits"))
    every = docs.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    filled = _dense(filled.unionByName(every).groupBy("w").agg(F.bit_or("bits").alias("bits")), ["w"], "bits")
    maybe = _lines(docs).where(F.get(filled, F.shiftright(place, 6).cast("int")).bitwiseAND(_bit(place)) != 0)
    # rows equal in doc_id and text stand at the same place
    return _word_sets(maybe.join(wanted, "at").select("sid", "text"), ranks).dropDuplicates(["sid"])


def _alike(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """``sid`` of the sets that are alike to the other one of a pair (``sid, other``)."""
    found = pairs.join(whole, "sid").join(whole.select(F.col("sid").alias("other"), F.col("ids").alias("other_ids")), "other")
    return found.where(F.size(F.array_intersect("ids", "other_ids")) * 9 >= (F.size("ids") + F.size("other_ids")) * 4).select("sid").distinct()


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, th, removed``: the numbers (from 0) of the lines to remove, for every document that has some.

    ``th`` is the hash of the text, which tells apart documents of one doc_id. A line goes if an earlier line, by
    doc_id, ``th`` and number, has an equal set or one of similarity 4/5 or more. A line without words never goes;
    a null doc_id comes first, a null text has no line, and rows equal in doc_id and text are one document.

    Each distinct set is looked up once, whatever its number of lines. A semi-join on the words of prefixes leaves the
    entries that can have a partner, one row each however many those are. Their sets are numbered in the order of their
    first lines and compared with the earliest set of a word first; only sets that it does not remove are compared with
    all earlier ones. Whole sets are taken once more from the texts.
    """
    docs = docs.select("doc_id", "text")
    ranks = slot_ranks(docs)
    n, name = F.col("n"), ["key", "sig", "sig2", "n"]
    prefix = F.slice("ids", F.lit(1), (n - F.ceil(n * 4 / F.lit(5)) + 1).cast("int"))
    # lines without words go when the sizes are written: before, a condition on them would have the words cut twice
    lines = materialise(_sets(_lines(docs), ranks).select("at", *name, prefix.alias("prefix")), "lines").where(n > 0)

    sets = lines.groupBy(*name).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("times"), F.first("prefix").alias("prefix"))
    sets = materialise(sets.select(F.monotonically_increasing_id().alias("number"), "*"), "line-sets")

    # a set of fewer than four words is alike to none but an equal one
    entries = sets.where(n >= 4).select("number", "sig", "sig2", n, F.posexplode("prefix").alias("pos", "word"))
    packed = F.shiftleft(n.cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    entries = entries.select("word", "number", "sig", "sig2", packed.alias("size"))
    some = entries.alias("x").join(entries.alias("y"), _fits("x", "y") & (F.col("x.number") != F.col("y.number")), "left_semi")
    some = materialise(some, "line-entries")
    wanted = sets.join(some.select("number").distinct(), "number").select("number", "at").orderBy("at")
    wanted = materialise(wanted.select(F.monotonically_increasing_id().alias("sid"), "*"), "line-wanted")
    some = materialise(some.join(wanted.select("number", "sid"), "number").drop("number"), "line-entries")
    whole = materialise(_whole_sets(docs, ranks, wanted.drop("number")), "line-ids")

    first = some.groupBy("word").agg(F.min("sid").alias("sid"), *[F.min_by(c, "sid").alias(c) for c in ("sig", "sig2", "size")])
    ends = [F.col("x.sid").alias("sid"), F.col("y.sid").alias("other")]
    earlier = F.col("y.sid") < F.col("x.sid")
    pairs = some.alias("x").join(first.alias("y"), _fits("x", "y") & earlier).select(*ends).distinct()
    gone = materialise(_alike(pairs, whole), "line-gone")
    still = some.join(gone, "sid", "left_anti")
    pairs = still.alias("x").join(some.alias("y"), _fits("x", "y") & earlier).select(*ends).distinct()
    gone = gone.union(_alike(pairs, whole)).join(wanted, "sid").select("number", F.lit(True).alias("gone"))

    verdict = sets.select("number", *name, "times", F.col("at").alias("first_at")).join(gone, "number", "left").where("gone OR times > 1")
    verdict = materialise(verdict.drop("number", "times"), "line-verdicts")
    judged = lines.select("at", *name).join(verdict, name).where("gone OR at <> first_at")
    return judged.groupBy("at.doc_id", "at.th").agg(F.sort_array(F.collect_set("at.line")).alias("removed"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """``docs``, all their columns, with the removed lines taken out of the texts; all rows stay.

    Which lines go is said at :func:`duplicate_lines`. A null text stays null, a text of which all lines go becomes empty,
    other texts keep their line ends; rows without a doc_id are rows like others; an empty table stays empty.
    """
    removed = materialise(duplicate_lines(docs).select(F.col("doc_id").alias("rd"), F.col("th").alias("rt"), "removed"), "line-removed")
    joined = docs.alias("d").join(removed.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.rd")) & (F.xxhash64("d.text") == F.col("r.rt")), "left")
    kept = F.array_join(F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains("r.removed", i)), "\n")
    text = F.when(F.col("r.removed").isNull(), F.col("d.text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed_lines`` of every document (a null text has no line)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = materialise(duplicate_lines(docs).select(F.col("doc_id").alias("rd"), F.col("th").alias("rt"), "removed"), "line-removed")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    joined = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("th") == F.col("rt")), "left")
    return joined.select("doc_id", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
                         F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))
