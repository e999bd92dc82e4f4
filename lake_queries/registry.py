"""Registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lake_queries.tables import Lake, table_sql
from quayside.session import tune_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a function of the lake; `sql` checks it over the tables in `uses`."""

    def register(build: Callable[[Lake], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Lake(tune_tables(spark), folder))
        if sql is not None:
            defined = ",\n".join(f"{t} AS ({table_sql(t)})" for t in uses.split())
            head = f"WITH {defined}\n" if defined else ""
            ORACLES[name] = f"{head}SELECT * FROM (\n{sql.strip()}\n)"
        return build

    return register
