"""Registration, table access and the views over the given tables both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeel.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            base, expressions = VIEWS[name]
            return self.read(base).selectExpr(*expressions)
        return self.read(name)

    def read(self, table: str) -> DataFrame:
        """The table; its schema is looked up once per query."""
        if table not in self._read:
            self._read[table] = self.spark.read.parquet(self.path(table))
        return self._read[table]

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` as query ``name``, with its oracle if it has one."""

    def register(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(prepare(spark), folder))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register


#: Views over the given tables, in SQL both engines read the same way.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    # one served request per event
    "calls": ("events", (
        "event_id", "ts", "user_id", "value", "props",
        "CASE user_id % 2 WHEN 0 THEN 'categorizer' ELSE 'fraud' END AS model",
        "CASE user_id % 3 WHEN 0 THEN 'uc0' WHEN 1 THEN 'uc1' ELSE 'uc2' END AS use_case",
        "CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-16' THEN '2' ELSE '1' END AS model_version",
        "CASE WHEN event_type = 'error' THEN 'error' WHEN value > 150 THEN 'timeout' ELSE 'ok' END AS outcome",
        "CASE event_type WHEN 'error' THEN 'fallback' ELSE 'model' END AS source",
        "value / 1000 AS latency",
        "CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '404' ELSE '200' END AS status",
        "CASE WHEN user_id % 5 = 0 THEN '/healthz' ELSE '/v1/analyze' END AS handler",
        "CASE WHEN user_id % 4 = 0 THEN 'api-7c9f-x1' ELSE 'api-5d2b-x2' END AS pod",
        "event_type AS prediction", "CASE event_type WHEN 'purchase' THEN value END AS paid",
    )),
    # a counter per series that restarts now and then
    "counters": ("events", (
        "event_id AS id", "ts",
        "CASE user_id % 3 WHEN 0 THEN 'uc0' WHEN 1 THEN 'uc1' ELSE 'uc2' END AS use_case",
        "CASE user_id % 2 WHEN 0 THEN 'categorizer' ELSE 'fraud' END AS model",
        "event_id % 173 AS value",
    )),
    # listings to be classified
    "listings": ("part", (
        "p_partkey", "p_name AS title", "p_retailprice - 899.5 AS price", "p_type AS category", "p_size", "p_brand",
    )),
    # orders to be promised a delivery time
    "deliveries": ("lineitem", (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice / 900 AS distance_km", "l_quantity AS weight_kg", "l_linenumber * 4 AS hour",
        "CASE l_returnflag WHEN 'A' THEN 'north' WHEN 'N' THEN 'south' ELSE 'centre' END AS zone",
    )),
    # promotions of model versions
    "promotions": ("orders", (
        "o_orderkey AS seq", "CONCAT('uc', CAST(o_custkey % 40 AS VARCHAR(10)), '-model') AS name",
        "o_orderkey % 9 AS version", "o_orderdate AS ts",
        "CASE o_orderstatus WHEN 'F' THEN 'manual' WHEN 'O' THEN 'cron' ELSE 'drift' END AS trigger",
    )),
    # pipeline runs
    "runs": ("orders", (
        "o_orderkey", "CONCAT('run-', CAST(o_orderkey AS VARCHAR(20))) AS run_id",
        "CONCAT('uc', CAST(o_custkey % 7 AS VARCHAR(10))) AS use_case",
        "CASE o_custkey % 2 WHEN 0 THEN 'categorizer' ELSE 'fraud' END AS model",
        "o_orderdate AS ts",
        "CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Succeeded' ELSE 'Running' END AS phase",
    )),
    # truth and prediction of a regression
    "regression": ("lineitem", (
        "l_orderkey", "l_extendedprice AS y", "52872 + 7 * l_quantity AS pred", "l_quantity",
    )),
    # truth and two models' answers of a classification
    "classified": ("documents", (
        "doc_id", "lang AS y", "source",
        "CASE doc_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE lang END AS candidate",
        "CASE doc_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' ELSE lang END AS champion",
    )),
}


def with_views(sql: str) -> str:
    """Put the views a query names in front of it as common table expressions."""
    used = [v for v in VIEWS if f"{{{v}}}" in sql]
    for view in used:
        sql = sql.replace(f"{{{view}}}", view)
    defined = [f"{v} AS (SELECT {', '.join(VIEWS[v][1])} FROM {VIEWS[v][0]})" for v in used]
    body = sql.strip()
    if not defined:
        return body
    if body[:4].upper() == "WITH":
        rest, keyword = body[5:].lstrip(), "WITH"
        if rest[:9].upper() == "RECURSIVE":
            rest, keyword = rest[10:].lstrip(), "WITH RECURSIVE"
        return f"{keyword} {', '.join(defined)}, {rest}"
    return f"WITH {', '.join(defined)} {body}"


# --- spelling of times in both engines -----------------------------------------------------

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(column: Column | str) -> Column:
    return F.date_format(column, STAMP)


def sql_stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def sql_bucket(ts: str, seconds: int) -> str:
    """Start of the tumbling window of ``seconds`` (aligned to the epoch)."""
    micros = seconds * 1_000_000
    return f"make_timestamp((epoch_us({ts}) // {micros}) * {micros})"


def r6(column: Column | str) -> Column:
    return F.round(column, 6)
