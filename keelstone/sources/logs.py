"""Change logs from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log: users are keys, errors delete, sign-ups and purchases insert, others upsert.

    Values are whole cents, so that sums are exact.
    """
    return as_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_log(e: DataFrame) -> DataFrame:
    """The rows of ``events``, a table or a stream, as a change log."""
    kind = F.col("event_type")
    op = F.when(kind == "error", "D").when(kind.isin("signup", "purchase"), "I").otherwise("U")
    return e.select(
        F.col("user_id").alias("k"), F.col("event_id").alias("seq"), op.alias("op"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"), F.when(kind == "purchase", F.col("props")).alias("blob"),
    )


#: The same in SQL.
EVENTS_LOG = """L AS (
  SELECT user_id AS k, event_id AS seq,
         CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'I' ELSE 'U' END AS op,
         CAST(round(value * 100) AS BIGINT) AS v, CASE WHEN event_type = 'purchase' THEN props END AS blob
  FROM events
)"""


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as inserts: order keys, total prices in cents."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("seq"), F.lit("I").alias("op"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"), F.lit(None).cast("string").alias("blob"))
