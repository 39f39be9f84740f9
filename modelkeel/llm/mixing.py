"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelkeel.llm.hashing import WORD
from modelkeel.session import materialise

WEIGHTS = (5, 2, 1)
CELL = 2000


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_number(digest, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def water_fill(sources: DataFrame, share_num: int = 3, share_den: int = 2, max_epochs: int = 2) -> DataFrame:
    """Target of each source: ``least(max_epochs * size, level * weight)`` with one level for all.

    ``sources``: key, weight, source_size. Sharing the wanted total by weight, clamping what is above
    its cap and sharing the excess again ends at the one level at which the targets add up to the total
    (or all caps are reached). That level follows from the sources in order of cap / weight: it is the
    first one that does not reach the next cap. Sources of size 0 have target 0.
    """
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("rank"))
    up_to = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    cap = F.col("source_size") * max_epochs
    steps = sources.select(
        "*",
        F.coalesce(F.sum(cap).over(up_to), F.lit(0)).alias("capped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up_to), F.lit(0))).alias("open_weight"),
        F.sum("source_size").over(every).alias("total"),
    )
    level = (F.col("total") * share_num - F.col("capped") * share_den).cast("double") / (F.col("open_weight") * share_den)
    found = F.max(F.when(level <= cap / F.col("weight"), level)).over(every)
    return steps.select(
        "key", "rank", "weight", "source_size", "n_docs",
        F.when(found.isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), found * F.col("weight"))).alias("target"),
    )


def mix(docs: DataFrame, seed: str = "mix", max_epochs: int = 2) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, part_words, taken`` of every row of ``docs``.

    Every document is taken ``floor(target / source_size)`` times; the rest of the ratio is a fraction of
    the documents taken once more. They are picked within cells of about ``CELL`` documents (a cell is a
    hash range of a source, so a hot source has many): ordered by size, every 1/fraction-th one with a
    seeded start. The largest document of a cell is the one taken in part: its first ``part_words`` words
    make up what the whole repetitions leave open.

    Null texts have size 0 and add nothing; a null source is a source of its own, last in order; a null
    doc_id is drawn by its size; repeated rows count as often as they occur; an empty table gives an
    empty result; columns other than doc_id, text and source are not read.
    """
    return _plan(docs, seed, max_epochs)


def _plan(docs: DataFrame, seed: str, max_epochs: int, *more: Column) -> DataFrame:
    """The columns of :func:`mix`, and ``more`` ones of ``docs`` after them."""
    rows = materialise(docs.select(
        F.col("doc_id"), F.col("source").alias("key"), n_words(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("draw"),
        F.struct(F.lit(0).alias("_"), *more).alias("more"),
    ), "mix-sizes")
    totals = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("key").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    sources = materialise(water_fill(ranked.withColumn("weight", weight), max_epochs=max_epochs), "mix-sources")

    cells = F.ceil(F.col("n_docs") / CELL)
    joined = rows.join(sources.withColumnRenamed("key", "source_key"), F.col("key").eqNullSafe(F.col("source_key")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = joined.select(
        "doc_id", F.col("key").alias("source"), "size", "source_size", "target", "draw", "rank", "more",
        F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("part"),
        (hex_number(F.col("draw"), 1) % cells).alias("cell"),
    )
    start = hex_number(F.md5(F.concat_ws("|", F.lit(seed), F.col("rank").cast("string"), F.col("cell").cast("string")).cast("binary")), 1) / F.lit(4294967296.0)
    cell = Window.partitionBy("rank", "cell")
    placed = drawn.withColumn("start", start).withColumn("place", F.row_number().over(cell.orderBy(F.desc("size"), "draw", "doc_id")))
    hit = F.floor((F.col("place") - 1) * F.col("part") + F.col("start")) - F.floor((F.col("place") - 2) * F.col("part") + F.col("start"))
    chosen = placed.withColumn("extra", F.when(F.col("place") > 1, hit).otherwise(0))
    wish = F.floor(F.col("part") * F.sum("size").over(cell) - F.sum(F.col("extra") * F.col("size")).over(cell) + 0.5)
    filled = chosen.withColumn("part_words", F.when(F.col("place") == 1, F.least(F.col("size"), F.greatest(wish, F.lit(0)))).otherwise(0).cast("long"))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return filled.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "part_words",
        (copies * F.col("size") + F.col("part_words")).cast("long").alias("taken"), "more.*",
    ).drop("_")


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0)), F.lit(1), count.cast("int")), "")


def take(docs: DataFrame, seed: str = "mix", max_epochs: int = 2) -> DataFrame:
    """The columns of :func:`mix` and ``texts``: what of each row is taken, the whole text for each of its copies, then the part.

    The part is the text up to the end of its word ``part_words``. A row of which nothing is taken has no texts.
    Rows alike in doc_id, source and text are matched with their plans one by one.
    """
    def numbered(rows: DataFrame, th: Column) -> DataFrame:
        keys = rows.withColumns({"k1": F.xxhash64("doc_id", "source", th), "k2": F.xxhash64(th, "source", "doc_id")})
        return keys.withColumn("k", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1")))

    plan = numbered(_plan(docs, seed, max_epochs, F.xxhash64("text").alias("th")), F.col("th")).drop("th")
    whole = numbered(docs.select("doc_id", "source", "text"), F.xxhash64("text")).drop("doc_id", "source")
    text, part = F.col("text"), F.col("part_words")
    cut = F.when(part < F.col("size"), first_words(text, part)).otherwise(text)
    none = F.array().cast("array<string>")
    texts = F.concat(F.array_repeat(text, F.col("copies").cast("int")), F.when(part > 0, F.array(cut)).otherwise(none))
    found = plan.join(whole, ["k1", "k2", "k"]).withColumn("texts", F.when(F.col("taken") > 0, texts).otherwise(none))
    return found.drop("k1", "k2", "k", "text")


def copies(taken: DataFrame) -> DataFrame:
    """``doc_id, source, copy, text``: a row for each text that :func:`take` gives out, copies numbered from 0."""
    return taken.select("doc_id", "source", F.posexplode("texts").alias("copy", "text"))


ORACLE = r"""
WITH r AS (SELECT doc_id, source AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
t AS (SELECT key, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM r GROUP BY key),
k AS (SELECT *, row_number() OVER (ORDER BY key NULLS LAST) - 1 AS rnk FROM t),
w AS (SELECT *, (ARRAY[5, 2, 1])[(rnk % 3 + 1)::INT]::BIGINT AS weight FROM k),
o AS (SELECT *, coalesce(sum(2 * source_size) OVER p, 0)::BIGINT AS capped,
  (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::BIGINT AS open_weight, (sum(source_size) OVER ())::BIGINT AS total
  FROM w WINDOW p AS (ORDER BY source_size / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total * 3 - capped * 2)::DOUBLE / (open_weight * 2) AS level FROM o),
f AS (SELECT *, max(CASE WHEN level <= (2 * source_size) / weight THEN level END) OVER () AS found FROM v),
s AS (SELECT key, rnk, weight, source_size, n_docs, CASE WHEN found IS NULL THEN (2 * source_size)::DOUBLE
  ELSE least((2 * source_size)::DOUBLE, found * weight) END AS target FROM f),
j AS (SELECT r.*, s.* EXCLUDE (key), CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
  ('0x' || substr(draw, 1, 8))::BIGINT % ceil(n_docs / 2000)::BIGINT AS cell FROM r JOIN s ON r.key IS NOT DISTINCT FROM s.key),
p AS (SELECT *, ratio - floor(ratio) AS part, ('0x' || substr(md5('mix|' || rnk || '|' || cell), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
  row_number() OVER (PARTITION BY rnk, cell ORDER BY size DESC, draw, doc_id) AS place FROM j),
e AS (SELECT *, CASE WHEN place > 1 THEN floor((place - 1) * part + start) - floor((place - 2) * part + start) ELSE 0 END AS extra FROM p),
n AS (SELECT *, CASE WHEN place = 1 THEN least(size, greatest(floor(part * sum(size) OVER w - sum(extra * size) OVER w + 0.5), 0)) ELSE 0 END::BIGINT AS part_words,
  (floor(ratio) + extra)::BIGINT AS copies FROM e WINDOW w AS (PARTITION BY rnk, cell))
SELECT doc_id, key AS source, size, source_size, target, copies, part_words, (copies * size + part_words)::BIGINT AS taken FROM n
"""


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
