"""Registry of the queries this library answers on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, tables)`` under a name, with the SQL that gives the same rows."""
    def add(fn: Callable[[SparkSession, Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(spark, Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn
    return add
