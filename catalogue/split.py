"""Exact splits, frozen samples and content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import Tables, query
from modelkeel.functions.ids import data_hash as frame_hash, request_id as rid
from modelkeel.operators import split as s

SEED, RATIO = 42, 0.25


@query("stratify_decision", """
    SELECT 'lang' AS target, false AS is_numeric, count(DISTINCT lang) AS distinct_values, count(DISTINCT lang) > 1 AS stratify FROM documents
    UNION ALL SELECT 'quality', true, count(DISTINCT quality), count(DISTINCT quality) BETWEEN 2 AND 20 FROM labels
    UNION ALL SELECT 'o_totalprice', true, count(DISTINCT o_totalprice), count(DISTINCT o_totalprice) BETWEEN 2 AND 20 FROM orders""")
def stratify_decision(t: Tables) -> DataFrame:
    parts = [s.stratify_decision(t.documents, "lang"), s.stratify_decision(t.labels, "quality"), s.stratify_decision(t.orders, "o_totalprice")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# rows of the stratum in md5 order; quotas by largest remainder
_STRATIFIED = f"""
    WITH hashed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}|' || doc_id)) AS r FROM documents),
    counts AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY 1),
    shares AS (SELECT lang, ceil(round(total * {RATIO}, 6)) AS wanted, ceil(round(total * {RATIO}, 6)) * n / total AS share FROM counts),
    ranked AS (SELECT *, floor(share) AS base, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, lang) AS o FROM shares),
    quotas AS (SELECT lang, base + CASE WHEN o <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM ranked)"""


@query("split_stratified", _STRATIFIED + """
    SELECT doc_id, h.lang, r <= quota AS is_holdout FROM hashed h JOIN quotas q ON q.lang = h.lang""")
def split_stratified(t: Tables) -> DataFrame:
    marked = s.with_holdout(t.documents.select("doc_id", "lang"), ["doc_id"], seed=SEED, ratio=RATIO, strata=["lang"])
    return marked.select("doc_id", "lang", "is_holdout")


@query("split_plain", f"""
    SELECT o_orderkey, row_number() OVER (ORDER BY md5('{SEED}|' || o_orderkey))
           <= (SELECT ceil(round(count(*) * {RATIO}, 6)) FROM orders) AS is_holdout FROM orders""")
def split_plain(t: Tables) -> DataFrame:
    return s.with_holdout(t.orders.select("o_orderkey"), ["o_orderkey"], seed=SEED, ratio=RATIO)


@query("reference_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('{SEED}|' || o_orderkey) LIMIT 2000")
def reference_sample(t: Tables) -> DataFrame:
    return s.frozen_sample(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], seed=SEED)


@query("split_summary", _STRATIFIED + """,
    parts AS (SELECT h.doc_id, r <= quota AS is_holdout FROM hashed h JOIN quotas q ON q.lang = h.lang),
    ref AS (SELECT doc_id FROM parts WHERE NOT is_holdout ORDER BY md5('42|' || doc_id) LIMIT 200)
    SELECT 'holdout' AS part, count(*) AS rows, sum(doc_id) AS key_sum FROM parts WHERE is_holdout
    UNION ALL SELECT 'reference', count(*), sum(doc_id) FROM ref
    UNION ALL SELECT 'train', count(*), sum(doc_id) FROM parts WHERE NOT is_holdout""")
def split_summary(t: Tables) -> DataFrame:
    """Train, holdout and the frozen reference of the documents by language."""
    train, holdout = s.train_holdout(t.documents.select("doc_id", "lang"), "lang", ["doc_id"], seed=SEED, ratio=RATIO)
    reference = s.frozen_sample(train, ["doc_id"], 200, seed=SEED)
    tagged = [f.select(F.lit(n).alias("part"), "doc_id") for n, f in (("train", train), ("holdout", holdout), ("reference", reference))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("key_sum")
    )


def sql_hash(columns: list[str], table: str, schema: str) -> str:
    """The multiset hash of a table in SQL: digest words summed over the rows, then the schema."""
    spelled = [f"CAST({c} AS VARCHAR)" for c in columns]
    text = " || ".join(f"coalesce(length({c}) || ':' || {c}, '~')" for c in spelled)
    words = ", ".join(f"sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS w{i}" for i in range(4))
    joined = " || ':' || ".join(["n", *[f"coalesce(w{i}, 0)" for i in range(4)], f"'{schema}'"])
    return f"""SELECT n AS rows, substr(md5({joined}), 1, 16) AS data_hash FROM (
        SELECT count(*) AS n, {words} FROM (SELECT md5({text}) AS d FROM {table}))"""


def sql_exact(x: str) -> str:
    """A double in SQL as a hexadecimal fraction and a power of two."""
    guess = f"floor(log2(abs({x})))::BIGINT"
    power = f"({guess} + CASE WHEN abs({x}) * pow(2.0, 52 - {guess}) >= pow(2.0, 53) THEN 1 WHEN abs({x}) * pow(2.0, 52 - {guess}) < pow(2.0, 52) THEN -1 ELSE 0 END)"
    digits = f"rtrim(format('{{:013x}}', (abs({x}) * pow(2.0, 52 - {power}))::BIGINT - 4503599627370496), '0')"
    number = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || '0x1.' || CASE WHEN {digits} = '' THEN '0' ELSE {digits} END || 'p' || {power}"
    return f"CASE WHEN {x} = 0 THEN '0' ELSE {number} END"


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", sql_exact("o_totalprice"),
                  "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')", "o_orderpriority"]
_ORDER_SCHEMA = ("o_orderkey bigint,o_custkey bigint,o_orderstatus string,o_totalprice double,o_orderdate timestamp_ntz,"
                 "o_orderpriority string")


@query("data_hash", sql_hash(_ORDER_COLUMNS, "orders", _ORDER_SCHEMA))
def data_hash(t: Tables) -> DataFrame:
    return frame_hash(t.orders)


@query("ingest_summary", f"""
    SELECT rows, data_hash, 'lang,text,doc_id' AS columns, 'default' AS profile FROM ({sql_hash(["lang", "text", "doc_id"], "documents", "lang string,text string,doc_id bigint")})""")
def ingest_summary(t: Tables) -> DataFrame:
    """What landing the documents reports: rows, columns, content hash of the whole texts."""
    frame = t.documents.select("lang", "text", "doc_id")
    return frame_hash(frame).select(
        "rows", "data_hash", F.lit(",".join(frame.columns)).alias("columns"), F.lit("default").alias("profile")
    )


@query("request_id", """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'req-' || event_id ELSE substr(md5(event_id || '|' || user_id), 1, 12) END AS request_id
    FROM events""")
def request_id(t: Tables) -> DataFrame:
    """Given ids win, an empty one counts as absent."""
    given = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("req-"), F.col("event_id"))).otherwise(F.lit(""))
    return t.events.select("event_id", rid(given, "event_id", "user_id").alias("request_id"))
