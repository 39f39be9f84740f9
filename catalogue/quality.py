"""Quality gate and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import Tables, query, r6
from modelkeel.operators import quality as q
from modelkeel.spec import ColumnCheck

_LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def labelled(t: Tables) -> DataFrame:
    """Documents with their labels where they have any: the one given frame with nulls."""
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    return docs.join(t.labels, "doc_id", "left")


@query("null_ratios", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_ratio
        FROM {_LABELLED}""" for c in ("doc_id", "lang", "quality", "toxic")))
def null_ratios(t: Tables) -> DataFrame:
    ratios = q.null_ratios(labelled(t), ["doc_id", "lang", "quality", "toxic"])
    return ratios.select("column", "rows", r6("null_ratio").alias("null_ratio"))


_BOUNDS = {"l_quantity": (0.0, 50.0), "l_extendedprice": (1000.0, 90000.0), "l_discount": (0.01, 0.2), "l_linenumber": (1.0, 7.0)}


@query("range_checks", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value,
        min({c}) < {lo} AS below, max({c}) > {hi} AS above FROM lineitem""" for c, (lo, hi) in _BOUNDS.items()))
def range_checks(t: Tables) -> DataFrame:
    return q.range_checks(t.lineitem, _BOUNDS)


@query("allowed_values", """
    SELECT 'category' AS "column", v AS value, n AS rows FROM (
        SELECT category AS v, count(*) AS n FROM {listings} WHERE category NOT IN ('SMALL', 'LARGE') GROUP BY 1 ORDER BY 1 LIMIT 5)
    UNION ALL SELECT 'p_brand', v, n FROM (
        SELECT p_brand AS v, count(*) AS n FROM {listings} WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY 1 ORDER BY 1 LIMIT 5)""")
def allowed_values(t: Tables) -> DataFrame:
    """First five unexpected values per column, in text order (a report)."""
    return q.unexpected_values(t.listings, {"category": ("SMALL", "LARGE"), "p_brand": ("Brand#1", "Brand#2")})


@query("except_allowed", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <= 1)")
def except_allowed(t: Tables) -> DataFrame:
    """Brands never seen among the smallest parts."""
    return q.except_allowed(t.part, "p_brand", t.part.filter("p_size <= 1"))


@query("intersect_values", """
    SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def intersect_values(t: Tables) -> DataFrame:
    customers = t.customer.withColumnRenamed("c_nationkey", "nationkey")
    return q.intersect_values(customers, t.supplier.withColumnRenamed("s_nationkey", "nationkey"), "nationkey")


_REQUIRED = {
    "doc_id": ColumnCheck("int"), "title": ColumnCheck("string"), "lang": ColumnCheck("string"),
    "price": ColumnCheck("number"), "hint": ColumnCheck("string", required=False),
}


@query("missing_columns", """
    SELECT c || ': missing column' AS violation, (SELECT count(*) FROM documents) AS rows FROM (VALUES ('title'), ('price')) AS v(c)""")
def missing_columns(t: Tables) -> DataFrame:
    """Required columns the documents do not have, with the rows concerned."""
    absent = q.missing_columns(t.documents, _REQUIRED)
    counted = t.documents.agg(F.count(F.lit(1)).alias("rows"))
    names = F.array(*[F.lit(f"{c}: missing column") for c in absent])
    return counted.select(F.explode(names).alias("violation"), "rows")


@query("union_heterogeneous", """
    SELECT kind, count(*) AS n, count(o_totalprice) AS with_price, count(l_quantity) AS with_quantity FROM (
        SELECT 'order' AS kind, o_totalprice, NULL AS l_quantity FROM orders
        UNION ALL SELECT 'item', NULL, l_quantity FROM lineitem
        UNION ALL SELECT 'event', NULL, NULL FROM events) GROUP BY 1""")
def union_heterogeneous(t: Tables) -> DataFrame:
    merged = q.union_records(
        t.orders.select(F.lit("order").alias("kind"), "o_totalprice"),
        t.lineitem.select(F.lit("item").alias("kind"), "l_quantity"),
        t.events.select(F.lit("event").alias("kind"), "event_type"),
    )
    return merged.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("with_price"), F.count("l_quantity").alias("with_quantity")
    )


_SCHEMA = {
    "doc_id": ColumnCheck("int", min=0),
    "lang": ColumnCheck("string", allowed=("en", "fr")),
    "n_chars": ColumnCheck("number", min=10, max=20000),
    "quality": ColumnCheck("int", max_null_ratio=0.25),
    "toxic": ColumnCheck("string", max_null_ratio=1.0),
    "title": ColumnCheck("string"),
    "hint": ColumnCheck("string", required=False),
}


@query("quality_violations", f"""
    WITH s AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi, avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END) AS gaps
               FROM {_LABELLED}),
    bad AS (SELECT string_agg('''' || lang || '''', ', ' ORDER BY lang) AS names FROM (
                SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'fr') ORDER BY 1 LIMIT 5))
    SELECT violation FROM (
        SELECT 'lang: unexpected values [' || names || ']' AS violation FROM bad WHERE names IS NOT NULL
        UNION ALL SELECT 'n_chars: min ' || lo || ' < 10' FROM s WHERE lo < 10
        UNION ALL SELECT 'n_chars: max ' || hi || ' > 20000' FROM s WHERE hi > 20000
        UNION ALL SELECT 'quality: null ratio ' || printf('%.3f', gaps) || ' > 0.25' FROM s WHERE gaps > 0.25
        UNION ALL SELECT 'toxic: expected string, got ' || (SELECT CASE typeof(any_value(toxic)) WHEN 'INTEGER' THEN 'int' ELSE 'bigint' END FROM labels)
        UNION ALL SELECT 'title: missing column')""")
def quality_violations(t: Tables) -> DataFrame:
    return q.violations(labelled(t), _SCHEMA).select("violation")
