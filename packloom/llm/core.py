"""Registry and shared steps of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

# Rows of one Arrow batch. Texts may be long, so batches stay at some megabytes.
BATCH_ROWS = "1000"


def session(spark: SparkSession) -> SparkSession:
    """The library's session settings, and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{folder}/{name}.parquet")


def registered(name: str, oracle: str | None = None):
    """Register a query (spark, folder) -> DataFrame with its DuckDB check."""

    def keep(fn):
        LLM_QUERIES[name] = fn
        if oracle:
            LLM_ORACLES[name] = oracle
        return fn

    return keep
