"""Model metrics and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import Tables, query, r6
from modelkeel.operators import metrics as m
from modelkeel.operators.gate import gate_columns
from modelkeel.operators.split import category_share as share_of

_SCORED = """(SELECT quality = 1 AS y, (n_chars % 97) / 97.0 AS score, (n_chars % 97) / 97.0 >= 0.5 AS pred
              FROM labels JOIN documents USING (doc_id))"""


def scored(t: Tables) -> DataFrame:
    """Labelled documents with a fixed score; ``labels`` has one row per labelled document."""
    score = (F.col("n_chars") % 97) / F.lit(97.0)
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        (F.col("quality") == 1).alias("y"), score.alias("score"), (score >= 0.5).alias("pred")
    )


@query("metric_accuracy", f"SELECT round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {_SCORED}")
def metric_accuracy(t: Tables) -> DataFrame:
    return scored(t).agg(r6(m.accuracy("y", "pred")).alias("accuracy"))


def _macro_sql(pred: str) -> str:
    return f"""
    WITH c AS (SELECT y, {pred} AS p, count(*) AS n FROM {{classified}} GROUP BY 1, 2),
    l AS (SELECT y AS label FROM c UNION SELECT p FROM c),
    f AS (SELECT label, 2.0 * sum(CASE WHEN y = label AND p = label THEN n ELSE 0 END)
          / (sum(CASE WHEN y = label THEN n ELSE 0 END) + sum(CASE WHEN p = label THEN n ELSE 0 END)) AS f1
          FROM l JOIN c ON c.y = label OR c.p = label GROUP BY 1)"""


@query("metric_f1_macro", _macro_sql("candidate") + "SELECT round(avg(f1), 6) AS f1_macro FROM f")
def metric_f1_macro(t: Tables) -> DataFrame:
    return m.f1_macro(t.classified, "y", "candidate").select(r6("f1_macro").alias("f1_macro"))


@query("metric_prf", f"""
    WITH s AS (SELECT sum((y AND pred)::INT) AS tp, sum((NOT y AND pred)::INT) AS fp, sum((y AND NOT pred)::INT) AS fn FROM {_SCORED})
    SELECT round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS "precision",
           round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
           round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM s""")
def metric_prf(t: Tables) -> DataFrame:
    chosen = m.binary_prf(F.col("y"), F.col("pred"))
    return scored(t).agg(*[r6(c).alias(n) for n, c in chosen.items()])


@query("metric_roc_auc", """
    WITH s AS (SELECT l_extendedprice AS score, sum((l_returnflag = 'A')::INT) AS pos, sum((l_returnflag <> 'A')::INT) AS neg
               FROM lineitem GROUP BY 1),
    c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
    SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS roc_auc FROM c""")
def metric_roc_auc(t: Tables) -> DataFrame:
    """Price as a score for the return flag: about as many scores as rows, with ties."""
    auc = m.roc_auc(t.lineitem, F.col("l_returnflag") == "A", F.col("l_extendedprice"))
    return auc.select(r6("roc_auc").alias("roc_auc"))


_REGRESSION = """
    SELECT avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse,
           1 - sum((pred - y) * (pred - y)) / (var_pop(y) * count(y)) AS r2 FROM {regression}"""


@query("metric_regression", f"SELECT round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2 FROM ({_REGRESSION})")
def metric_regression(t: Tables) -> DataFrame:
    chosen = m.regression(F.col("y"), F.col("pred"))
    places = {"mae": 4, "rmse": 4, "r2": 6}
    return t.regression.agg(*[F.round(c, places[n]).alias(n) for n, c in chosen.items()])


@query("metrics_by_task", f"""
    SELECT 'regression' AS task, 'mae' AS metric, round(mae, 4) AS value FROM ({_REGRESSION})
    UNION ALL SELECT 'regression', 'r2', round(r2, 4) FROM ({_REGRESSION})
    UNION ALL SELECT 'classification', 'accuracy', round(avg(CASE WHEN y = champion THEN 1.0 ELSE 0.0 END), 4) FROM {{classified}}
    UNION ALL SELECT 'classification', 'f1_macro', (SELECT round(avg(f1), 4) FROM ({_macro_sql("champion")} SELECT f1 FROM f))""")
def metrics_by_task(t: Tables) -> DataFrame:
    both = [
        m.metrics_for_task(t.regression, "regression", "y", "pred").withColumn("task", F.lit("regression")),
        m.metrics_for_task(t.classified, "classification", "y", "champion").withColumn("task", F.lit("classification")),
    ]
    return both[0].unionByName(both[1]).select("task", "metric", F.round("value", 4).alias("value"))


@query("class_weights", """
    SELECT lang AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
    FROM documents GROUP BY 1""")
def class_weights(t: Tables) -> DataFrame:
    return m.class_weights(t.documents, "lang").select("label", "n", r6("weight").alias("weight"))


@query("category_share", "SELECT round(avg(CASE WHEN category = 'PROMO' THEN 1.0 ELSE 0.0 END), 6) AS share FROM {listings}")
def category_share(t: Tables) -> DataFrame:
    return share_of(t.listings, F.col("category") == "PROMO").select(r6("share").alias("share"))


@query("gate_decision", """
    WITH a AS (SELECT source, avg(CASE WHEN y = candidate THEN 1.0 ELSE 0.0 END) AS cand,
                      CASE WHEN source <> 'src3' THEN avg(CASE WHEN y = champion THEN 1.0 ELSE 0.0 END) END AS champ,
                      source NOT IN ('src5', 'src6') AS higher FROM {classified} GROUP BY 1),
    d AS (SELECT *, CASE WHEN higher THEN cand - champ ELSE champ - cand END AS gain FROM a)
    SELECT source, champ IS NULL OR gain > 0.01 AS promote,
           CASE WHEN champ IS NULL THEN 'no champion yet'
                WHEN gain > 0.01 THEN printf('accuracy improved by %.4f', gain)
                ELSE printf('accuracy did not improve (%+.4f, need > 0.01)', gain) END AS reason FROM d""")
def gate_decision(t: Tables) -> DataFrame:
    """The gate per source: one source has no champion, two have a metric where lower is better."""
    measured = t.classified.groupBy("source").agg(
        m.accuracy("y", "candidate").alias("cand"), m.accuracy("y", "champion").alias("champ")
    ).withColumn("champ", F.when(F.col("source") != "src3", F.col("champ")))
    promote, reason = gate_columns(
        F.lit("accuracy"), F.col("cand"), F.col("champ"), ~F.col("source").isin("src5", "src6"), F.lit(0.01).cast("double")
    )
    return measured.select("source", promote.alias("promote"), reason.alias("reason"))
