"""Registry of queries and their oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``oracle`` only its rows are checked."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Derived tables whose definition reads the same in Spark and in the oracle.

# Events with missing, blank and non-numeric amounts.
GAPS_COLUMNS = """event_id, ts, user_id, event_type,
    CASE WHEN value < 5 THEN NULL WHEN value < 10 THEN '' WHEN value < 15 THEN 'n/a'
         ELSE CAST(value AS {text}) END AS amount,
    CASE WHEN value < 20 THEN NULL ELSE event_type END AS kind"""
# Orders whose prices share values, so that ranks have ties.
TIES_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, CAST(FLOOR(o_totalprice / 1000) * 1000 AS DOUBLE) AS price"

GAPS_SQL = f"SELECT {GAPS_COLUMNS.format(text='VARCHAR')} FROM events"
TIES_SQL = f"SELECT {TIES_COLUMNS} FROM orders"


def derived(df: DataFrame, columns: str) -> DataFrame:
    """``df`` projected by a comma-separated SQL column list."""
    return df.sparkSession.sql(f"SELECT {columns} FROM {{source}}", source=df)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "events"), GAPS_COLUMNS.format(text="STRING"))


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "orders"), TIES_COLUMNS)
