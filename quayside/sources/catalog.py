"""Scans of the relational catalog and the work tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.schemas import TABLES, schema


def scan_snapshot(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A catalog or work table kept as Parquet below `folder`, under its declared columns."""
    reader = spark.read.schema(schema(table)) if table in TABLES else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{table}")


def table_statistics(spark: SparkSession, table: str, columns: list[str]) -> DataFrame:
    """Statistics the catalog holds for columns, by `column_name`, `measure`, `value`."""
    found = None
    for name in columns:
        one = spark.sql(f"DESCRIBE EXTENDED {table} `{name}`").select(
            F.lit(name).alias("column_name"),
            F.col("info_name").alias("measure"),
            F.col("info_value").alias("value"),
        )
        found = one if found is None else found.unionByName(one)
    return found.where("value <> 'NULL'")


def scan_database(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    tasks: int = 32,
    fetch_rows: int = 10_000,
    **options: str,
) -> DataFrame:
    """A catalog table in its database, read by ranges of a numeric key.

    Without a key one task reads the table, which suits dimensions only.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch_rows, **options)
    if key and bounds:
        reader = reader.options(
            partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=tasks
        )
    return reader.load()
