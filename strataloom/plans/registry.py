"""Queries over the tables of a folder, each with its SQL, collected by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register f(t) as a query; t(name) gives a table of the folder."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda x: table(spark, sf_dir, x))
        if sql:
            SQL[name] = sql
        return f

    return add


def joined_list(name: str):
    from pyspark.sql import functions as F

    return F.array_join(name, "␟").alias(name)
