"""Registration of queries, tables, and frames that several queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its name, with SQL for the same rows."""

    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


class Tables:
    """``tables.orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


#: Requirement sentences made of orders: portable expressions, used by Spark and by the SQL.
MODAL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'shall' WHEN '2-HIGH' THEN 'must' WHEN '3-MEDIUM' THEN 'should' WHEN '4-NOT SPECIFIED' THEN 'may' ELSE 'can' END"
_START = "CASE WHEN o_orderkey % 7 = 0 THEN 'For example, ' WHEN o_orderkey % 11 = 3 THEN 'This page 12 says that ' ELSE '' END"
_SUBJECT = "CASE o_orderstatus WHEN 'O' THEN 'When the order fails, the system ' WHEN 'P' THEN 'If access is denied by the desk, the user ' ELSE 'The system ' END"
_END = (
    "CASE o_orderkey % 6 WHEN 0 THEN ' process the order ' || CAST(o_orderkey AS STRING) || ' within two working days.'"
    " WHEN 1 THEN ' send all invoices of order ' || CAST(o_orderkey AS STRING) || ' to every customer immediately.'"
    " WHEN 2 THEN ' keep a copy of order ' || CAST(o_custkey AS STRING) || ' in the archive for ten years'"
    " WHEN 3 THEN ' note that the next release of order ' || CAST(o_custkey AS STRING) || ' is open.'"
    " WHEN 4 THEN ' store ' || CAST(o_orderkey AS STRING) || '.'"
    " ELSE ' be told of the required order ' || CAST(o_custkey AS STRING) || ' and log the error.' END"
)
TEXT = f"{_START} || {_SUBJECT} || {MODAL} || {_END}"
REQUIREMENTS = f"SELECT o_orderkey AS item_id, o_custkey AS doc_id, o_orderpriority AS source, {MODAL} AS modal, {TEXT} AS text FROM orders"
#: The same for SQL that begins with WITH.
REQ = f"req AS ({REQUIREMENTS.replace('STRING', 'VARCHAR')})"


def requirements(tables: Tables, orders: DataFrame | None = None) -> DataFrame:
    """The sentence comes out of a generator, so that filters and projections above it read it and don't make it again."""
    orders = tables.orders if orders is None else orders
    return orders.selectExpr("o_orderkey AS item_id", "o_custkey AS doc_id", "o_orderpriority AS source", f"{MODAL} AS modal", f"explode(array({TEXT})) AS text")


#: Documents with the scores that labels give them: no label, no score.
SCORED = "scored AS (SELECT d.doc_id, d.source AS model, d.lang AS family, CAST(l.toxic + 1 AS INTEGER) AS tier, l.quality AS score, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def scored(tables: Tables) -> DataFrame:
    labels = tables.labels.select("doc_id", F.col("quality").alias("score"), (F.col("toxic") + 1).alias("tier"))
    docs = tables.documents.select("doc_id", F.col("source").alias("model"), F.col("lang").alias("family"), "n_chars")
    return docs.join(labels, "doc_id", "left")


FAMILIES = ["en", "de", "fr", "es"]

#: Each turn of a conversation and the next one as the texts of a base item and its probe.
PAIR_ID = "conv_id + turn * 1000000000"
PAIRS = "pairs AS (SELECT a.conv_id + a.turn * 1000000000 AS id, a.text AS base, b.text AS probe FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def pairs(tables: Tables) -> DataFrame:
    after = tables.conversations.selectExpr("conv_id + (turn - 1) * 1000000000 AS id", "text AS probe")
    return tables.conversations.selectExpr(f"{PAIR_ID} AS id", "text AS base").join(after, "id")
