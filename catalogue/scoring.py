"""Scoring, scalar functions and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import Tables, query, r6
from modelkeel.functions.text import bigrams, words
from modelkeel.functions.vectors import argmax_label as argmax, as_proba, positive_proba as positive, prefix_keys
from modelkeel.operators import features as f, scoring as s
from modelkeel.operators.vocabulary import VocabularyTfidf, numbered

# medians and keywords of the listings of this folder; the defaults name other categories
_MEDIANS = {"ECONOMY": 300.0, "PROMO": 350.0, "SMALL": 40.0, "LARGE": 90.0}
_KEYWORDS = ("ring", "blue gear")
_MEDIAN_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _MEDIANS.items()) + " END"
_REASONS_SQL = f"""concat(CASE WHEN price <= 1.0 THEN 'price_at_floor ' ELSE '' END,
    CASE WHEN price < 0.15 * {_MEDIAN_SQL} THEN 'price_below_category_floor ' ELSE '' END,
    CASE WHEN {' OR '.join(f"contains(lower(title), '{k}')" for k in _KEYWORDS)} THEN 'suspicious_keyword ' ELSE '' END)"""


@query("fraud_rules", f"""
    SELECT p_partkey, trim({_REASONS_SQL}) AS reasons, CAST(CASE WHEN {_REASONS_SQL} = '' THEN 0.05 ELSE 0.9 END AS DOUBLE) AS score FROM {{listings}}""")
def fraud_rules(t: Tables) -> DataFrame:
    ruled = s.fraud_rules(t.listings, s.medians_table(t.spark, _MEDIANS), _KEYWORDS)
    return ruled.select("p_partkey", F.array_join("reasons", " ").alias("reasons"), "score")


@query("score_with_fallback", f"""
    SELECT p_partkey, p_partkey % 3 <> 0 AS answered, source, model_version, score, score_raw >= 0.5 AS is_suspicious, reasons FROM (
        SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'model' ELSE 'fallback' END AS source,
               CASE WHEN p_partkey % 3 <> 0 THEN '7' ELSE 'rules' END AS model_version,
               CASE WHEN p_partkey % 3 <> 0 THEN p_size / 64.0 WHEN {_REASONS_SQL} = '' THEN 0.05 ELSE 0.9 END AS score_raw,
               round(CASE WHEN p_partkey % 3 <> 0 THEN p_size / 64.0 WHEN {_REASONS_SQL} = '' THEN 0.05 ELSE 0.9 END, 4) AS score,
               CASE WHEN p_partkey % 3 <> 0 THEN '' ELSE trim({_REASONS_SQL}) END AS reasons FROM {{listings}})""")
def score_with_fallback(t: Tables) -> DataFrame:
    """A model that answers two listings of three; the rules answer the rest."""
    p = F.col("p_size") / F.lit(64.0)
    answers = t.listings.withColumn("proba", F.when(F.col("p_partkey") % 3 != 0, F.array(1 - p, p)))
    scored = s.score_with_fallback(answers, s.medians_table(t.spark, _MEDIANS), "7", keywords=_KEYWORDS)
    return scored.select(
        "p_partkey", F.col("proba").isNotNull().alias("answered"), "source", "model_version", "score", "is_suspicious",
        F.array_join("reasons", " ").alias("reasons"),
    )


_PROBA = [f"(doc_id * {m} + {a}) % 11" for m, a in ((3, 1), (5, 2), (7, 3), (2, 4), (9, 5), (4, 6), (6, 7))]


@query("argmax_label", f"""
    SELECT doc_id, CASE list_position(p, list_max(p)) WHEN 1 THEN 'books' WHEN 2 THEN 'electronics' WHEN 3 THEN 'fashion' WHEN 4 THEN 'home'
           WHEN 5 THEN 'kids' WHEN 6 THEN 'sports' ELSE '6' END AS label
    FROM (SELECT doc_id, [{', '.join(_PROBA)}] AS p FROM documents)""")
def argmax_label(t: Tables) -> DataFrame:
    """Seven scores, six labels: the first maximum wins, an unnamed class is its index."""
    proba = F.array(*[F.expr(p).cast("double") for p in _PROBA])
    return t.documents.select("doc_id", argmax(proba, s.CATEGORIES).alias("label"))


@query("positive_proba", """
    SELECT event_id, CASE WHEN event_id % 3 = 2 THEN round(value, 4) ELSE round(value / 2, 4) END AS positive FROM events""")
def positive_proba(t: Tables) -> DataFrame:
    """Answers in JSON as a pair, as a one-element list, or as a bare number."""
    v, half = F.col("value"), F.col("value") / 2
    answer = (
        F.when(F.col("event_id") % 3 == 0, F.to_json(F.array(v, half)))
        .when(F.col("event_id") % 3 == 1, F.to_json(F.array(half)))
        .otherwise(v.cast("string"))
    )
    return t.events.select("event_id", F.round(positive(as_proba(answer)), 4).alias("positive"))


@query("instances_payload", """
    SELECT p_partkey, '{"instances":[{"title":["' || title || '"],"p_size":[' || p_size || ']}]}' AS body FROM {listings}""")
def instances_payload(t: Tables) -> DataFrame:
    return t.listings.select("p_partkey", s.instances_payload(["title", "p_size"]).alias("body"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("prefix_metric_map", """
    SELECT lang, 'holdout_' || metric AS metric, round(value, 4) AS value FROM (
        SELECT lang, 'rows' AS metric, count(*)::DOUBLE AS value FROM documents GROUP BY 1
        UNION ALL SELECT lang, 'mean_chars', avg(n_chars) FROM documents GROUP BY 1)""")
def prefix_metric_map(t: Tables) -> DataFrame:
    measured = t.documents.groupBy("lang").agg(
        F.create_map(F.lit("rows"), F.count(F.lit(1)).cast("double"), F.lit("mean_chars"), F.avg("n_chars")).alias("m")
    )
    return measured.select("lang", F.explode(prefix_keys(F.col("m"), "holdout_")).alias("metric", "value")).withColumn(
        "value", F.round("value", 4)
    )


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_TERMS = f"""tokens AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
    terms AS (SELECT doc_id, unnest(w) AS term FROM tokens
        UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tokens),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2)"""


@query("ngrams", f"""
    WITH tokens AS (SELECT doc_id, {_TOKENS} AS w FROM documents)
    SELECT doc_id, len(w) AS words, greatest(len(w) - 1, 0) AS pairs,
           md5(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|')) AS pairs_hash FROM tokens""")
def ngrams(t: Tables) -> DataFrame:
    """Words and neighbouring pairs of the whole text."""
    tokens = t.documents.select("doc_id", words(F.col("text")).alias("w"))
    paired = tokens.withColumn("b", bigrams(F.col("w")))
    return paired.select(
        "doc_id", F.size("w").alias("words"), F.size("b").alias("pairs"), F.md5(F.array_join("b", "|")).alias("pairs_hash")
    )


@query("doc_frequency", f"WITH {_TERMS} SELECT term, df FROM df")
def doc_frequency(t: Tables) -> DataFrame:
    return f.document_frequency(t.documents, "text")


@query("tfidf_terms", f"""
    WITH {_TERMS},
    raw AS (SELECT doc_id, term, df, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS raw
            FROM tf JOIN df USING (term)),
    unit AS (SELECT term, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)
    SELECT term, max(df) AS df, round(sum(weight), 6) AS total_weight FROM unit GROUP BY 1""")
def tfidf_terms(t: Tables) -> DataFrame:
    """Weight every term collects over all documents."""
    weights = f.tfidf_weights(t.documents, "doc_id", "text")
    return weights.groupBy("term").agg(F.max("df").alias("df"), r6(F.sum("weight")).alias("total_weight"))


@query("log1p_standardize", """
    SELECT o_orderkey, round((ln(1 + o_totalprice) - m) / s, 6) AS o_totalprice_scaled
    FROM orders, (SELECT avg(ln(1 + o_totalprice)) AS m, stddev_pop(ln(1 + o_totalprice)) AS s FROM orders)""")
def log1p_standardize(t: Tables) -> DataFrame:
    scaled = f.log1p_standardised(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return scaled.select("o_orderkey", r6("o_totalprice_scaled").alias("o_totalprice_scaled"))


@query("one_hot", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (zone = 'north')::INT AS zone_north, (zone = 'south')::INT AS zone_south,
           0 AS zone_east, 0 AS zone_west FROM {deliveries}""")
def one_hot(t: Tables) -> DataFrame:
    """An undeclared zone has zeros everywhere."""
    hot = f.one_hot(t.deliveries, "zone", ("north", "south", "east", "west"))
    return hot.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[f"zone_{z}" for z in ("north", "south", "east", "west")])


@query("category_medians", "SELECT category, round(quantile_cont(price, 0.5), 6) AS median FROM {listings} GROUP BY 1")
def category_medians(t: Tables) -> DataFrame:
    return s.category_medians(t.listings).select("category", r6("median").alias("median"))


@query("text_vectors", f"""
    WITH {_TERMS},
    raw AS (SELECT doc_id, term, df, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS raw
            FROM tf JOIN df USING (term)),
    unit AS (SELECT doc_id, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM raw)
    SELECT doc_id, count(w) AS terms, round(coalesce(sum(w), 0), 6) AS weight, round(coalesce(max(w), 0), 6) AS heaviest
    FROM documents LEFT JOIN unit USING (doc_id) GROUP BY 1""")
def text_vectors(t: Tables) -> DataFrame:
    """The sparse vector of every document over the exact vocabulary of all: entries, their sum, the largest."""
    stage = VocabularyTfidf(inputCol="text", outputCol="vector")
    docs = t.documents.select("doc_id", "text")
    values = F.unwrap_udt("vector")["values"]
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    vectors = stage.fit(docs).transform(docs)
    return vectors.select("doc_id", F.size(values).cast("long").alias("terms"), r6(total).alias("weight"),
                          r6(F.coalesce(F.array_max(values), F.lit(0.0))).alias("heaviest"))


@query("vocabulary_ids", f"WITH {_TERMS} SELECT term, df, true AS dense FROM df")
def vocabulary_ids(t: Tables) -> DataFrame:
    """The numbered vocabulary: every number from 0 to one less than the terms, once."""
    terms = numbered(f.document_frequency(t.documents, "text"))
    counts = terms.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))
    dense = (F.col("n") == F.col("ids")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    return terms.join(F.broadcast(counts.select(dense.alias("dense"))), F.lit(True)).select("term", "df", "dense")
