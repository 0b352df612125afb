"""Registered queries over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL oracle where SQL can express it."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "w1_rolling_gate",
    """
    WITH v AS (
      SELECT event_id, user_id % 16 AS run,
             CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'FAILURE' ELSE 'SAFE' END AS verdict
      FROM events),
    g AS (
      SELECT verdict,
             count(*) OVER w = 50 AND avg(CASE WHEN verdict = 'SAFE' THEN 1.0 ELSE 0.0 END) OVER w < 0.30 AS active
      FROM v WINDOW w AS (PARTITION BY run ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
    SELECT verdict, active, count(*) AS n FROM g GROUP BY verdict, active
    """,
)
def rolling_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "FAILURE").otherwise("SAFE")
    v = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 16).alias("run"), verdict.alias("verdict"))
    gate = history.rolling_gate(v, "run", "event_id", F.col("verdict") == "SAFE")
    return gate.groupBy("verdict", "active").agg(F.count("*").alias("n"))
