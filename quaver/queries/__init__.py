"""Registered queries and their SQL counterparts.

``QUERIES`` maps a name to a function of (spark, folder); ``SQL`` maps a name to
the statement that an independent engine runs on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaver.sources.readers import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


from quaver.queries import (  # noqa: E402, F401
    text_queries,
    noise_queries,
    table_queries,
    split_queries,
    pair_queries,
    thread_queries,
    source_queries,
    metric_queries,
    result_queries,
    vector_queries,
    model_queries,
)
