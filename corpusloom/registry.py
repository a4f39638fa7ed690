"""Registry that keeps a Spark query and its SQL oracle side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Operator:
    name: str
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Operator] = {}


def operator(name: str, sql: str | None = None):
    """Register ``query(spark, sf_dir)`` under ``name``; sql: the same rows from DuckDB, if SQL can say it."""

    def register(query):
        if name in REGISTRY and REGISTRY[name].query is not query:
            raise ValueError(f"two queries are named {name}")
        REGISTRY[name] = Operator(name, query, sql)
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
