"""Where queries register. A query gets a session and a folder of parquet tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from larder.plans.oracle_tables import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, more: Mapping[str, str] | None = None):
    """Register a function under a name, with the SQL that gives the same rows; ``more`` are tables that the SQL names."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_tables(sql, more)
        return fn

    return register
