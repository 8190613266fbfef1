"""Registry of queries and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is checked by tests on small fixtures only."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Orders with columns of every semantic type, made by the same expressions on both sides.
MIXED_SQL = """
mixed AS (
  SELECT o_orderkey,
         nullif(o_orderstatus, 'F') AS status,
         '$' || CAST(o_totalprice AS VARCHAR) AS price_text,
         strftime(o_orderdate, '%Y-%m-%d') AS date_text,
         CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS flag,
         o_totalprice,
         o_orderpriority AS priority,
         'order ' || CAST(o_orderkey AS VARCHAR) AS note
  FROM orders
)
"""
MIXED_COLUMNS = ["o_orderkey", "status", "price_text", "date_text", "flag", "o_totalprice", "priority", "note"]
MIXED_TEXTS = ["status", "price_text", "date_text", "flag", "priority", "note"]


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("F")).alias("status"),
        F.concat(F.lit("$"), F.col("o_totalprice").cast("string")).alias("price_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"),
        F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("flag"),
        "o_totalprice",
        F.col("o_orderpriority").alias("priority"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("note"),
    )


# Number texts in every shape the parsers know, one shape per order.
DIRTY_SQL = """
dirty AS (
  SELECT o_orderkey,
         CASE o_orderkey % 12
           WHEN 0 THEN CAST(o_totalprice AS VARCHAR)
           WHEN 1 THEN '$' || CAST(o_totalprice AS VARCHAR)
           WHEN 2 THEN '(' || CAST(o_totalprice AS VARCHAR) || ')'
           WHEN 3 THEN CAST(o_orderkey AS VARCHAR) || '%'
           WHEN 4 THEN '12d'
           WHEN 5 THEN '1e400'
           WHEN 6 THEN 'NaN'
           WHEN 7 THEN ''
           WHEN 8 THEN ' abc '
           WHEN 9 THEN CAST(o_orderkey AS VARCHAR) || '-2'
           WHEN 10 THEN ' 1,234,' || CAST(100 + o_orderkey % 900 AS VARCHAR) || '.5 '
           ELSE NULL END AS raw
  FROM orders
)
"""


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    key, price = k.cast("string"), F.col("o_totalprice").cast("string")
    turn = k % 12
    raw = (
        F.when(turn == 0, price)
        .when(turn == 1, F.concat(F.lit("$"), price))
        .when(turn == 2, F.concat(F.lit("("), price, F.lit(")")))
        .when(turn == 3, F.concat(key, F.lit("%")))
        .when(turn == 4, "12d")
        .when(turn == 5, "1e400")
        .when(turn == 6, "NaN")
        .when(turn == 7, "")
        .when(turn == 8, " abc ")
        .when(turn == 9, F.concat(key, F.lit("-2")))
        .when(turn == 10, F.concat(F.lit(" 1,234,"), (k % 900 + 100).cast("string"), F.lit(".5 ")))
    )
    return table(spark, folder, "orders").select("o_orderkey", raw.alias("raw"))


# Date texts in the shapes of the date parsers.
DATES_SQL = """
dates AS (
  SELECT o_orderkey, o_totalprice,
         CASE o_orderkey % 6
           WHEN 0 THEN strftime(o_orderdate, '%Y')
           WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
           WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
           WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d')
           WHEN 4 THEN 'bad'
           ELSE NULL END AS raw
  FROM orders
)
"""


def dates(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.col("o_orderkey") % 6
    raw = (
        F.when(turn == 0, F.date_format("o_orderdate", "yyyy"))
        .when(turn == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(turn == 2, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(turn == 3, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .when(turn == 4, "bad")
    )
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice", raw.alias("raw"))


# Whole conversation texts, each followed by one of the literal questions.
ASKED = (
    "show type distribution",
    "show top categories",
    "Movie vs Series",
    "titles after 2020",
    "monthly trend since 2021",
    "before 2022 only",
    "top 7 by price",
    "how many orders by role",
    "average order_total per status",
    "total revenue by month as a pie",
    "scatter of price and quantity?",
    "lowest 250 scores in assistant",
)


def _asked_sql() -> str:
    arms = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(ASKED))
    return f"""
asked AS (
  SELECT conv_id, turn, role, text || ' ' || CASE (conv_id + turn) % {len(ASKED)} {arms} END AS long_text,
         CASE (conv_id + turn) % {len(ASKED)} {arms} END AS question
  FROM conversations
)
"""


ASKED_SQL = _asked_sql()


def asked(spark: SparkSession, folder: str) -> DataFrame:
    turn = (F.col("conv_id") + F.col("turn")) % len(ASKED)
    question = F.get(F.array(*[F.lit(t) for t in ASKED]), turn.cast("int"))
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.concat("text", F.lit(" "), question).alias("long_text"),
        question.alias("question"),
    )
