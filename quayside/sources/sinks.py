"""Tables and files the lake writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions import names
from quayside.functions.partitions import quoted
from quayside.sources.objects import unescaped


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def create_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    location: str,
    file_format: str = "parquet",
    partition_columns: list[str] | None = None,
    **options: str,
) -> None:
    """An external table; `csv` for delimited text, `orc`, `parquet`."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = f" PARTITIONED BY ({', '.join(partition_columns)})" if partition_columns else ""
    given = ", ".join(f"'{k}' '{v}'" for k, v in options.items())
    with_options = f" OPTIONS ({given})" if given else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {file_format}{with_options}{by} LOCATION '{location}'"
    )


def insert(df: DataFrame, table: str) -> None:
    df.write.insertInto(table)


def create_table_as(df: DataFrame, name: str, location: str, limit: int | None = None) -> None:
    kept = df if limit is None else df.limit(limit)
    kept.write.option("path", location).saveAsTable(name)


def _spec(part_name: Column) -> Column:
    """`k=v/k2=v2`, as the catalog spells it, as a partition specification."""
    return F.array_join(
        F.transform(
            F.split(part_name, "/"),
            lambda p: F.concat(
                F.lit("`"), F.substring_index(p, "=", 1), F.lit("`="),
                quoted(unescaped(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)))),
            ),
        ),
        ", ",
    )


def _drop_partitions(spark: SparkSession, table: str, specs: DataFrame, at_once: int = 200) -> None:
    """Drop partitions by their `spec`, in statements of bounded size."""
    batch: list[str] = []
    for row in specs.select("spec").toLocalIterator():
        batch.append(f"PARTITION ({row.spec})")
        if len(batch) == at_once:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(batch)}")
            batch.clear()
    if batch:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(batch)}")


def drop_object(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def without_dropped(registry: DataFrame, items: DataFrame) -> DataFrame:
    """The registry of tables without those a drop item names."""
    dropped = items.where(F.col("wf_type") == 7).select(
        names.database_name(F.col("namespace")).alias("database_name"),
        names.table_name(
            F.col("object_name"), F.col("usage_code"), F.col("file_type"), F.col("correlation_data")
        ).alias("table_name"),
    )
    return registry.join(dropped.distinct(), ["database_name", "table_name"], "left_anti")


def append_items(items: DataFrame, path: str) -> None:
    items.write.mode("append").parquet(path)


def add_partitions(spark: SparkSession, table: str, parts: DataFrame, at_once: int = 200) -> int:
    """Point a table's partitions at their places. A repeat changes nothing.

    `parts` has `spec`, such as `k='v', k2='v2'` (values as `quoted` spells them), and
    `location`. They are metadata of one load and go to the catalog in statements of
    bounded size.
    """
    done, batch = 0, []

    def send() -> None:
        dropped = ", ".join(f"PARTITION ({p.spec})" for p in batch)
        added = " ".join(f"PARTITION ({p.spec}) LOCATION {p.location}" for p in batch)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {dropped}")
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {added}")

    for part in parts.select("spec", quoted(F.col("location")).alias("location")).toLocalIterator():
        batch.append(part)
        if len(batch) == at_once:
            send()
            done, batch = done + len(batch), []
    if batch:
        send()
    return done + len(batch)


def listed_partitions(spark: SparkSession, table: str, spec: str | None = None) -> DataFrame:
    """Names of a table's partitions, all or those of a partial spec."""
    part = f" PARTITION ({spec})" if spec else ""
    return spark.sql(f"SHOW PARTITIONS {table}{part}").withColumnRenamed("partition", "part_name")


def replace_partitions(
    spark: SparkSession, table: str, key: str, latest: DataFrame, at_once: int = 200
) -> int:
    """Drop a singleton's dated partitions and add the latest.

    Partitions can be dropped by equality only, so the dated ones are listed. A
    singleton keeps one generation of them. `latest` is as for `add_partitions`.
    """
    value = F.regexp_extract("part_name", f"(?i)(?:^|/){key}=([^/]*)", 1)
    dated = listed_partitions(spark, table).where(value > "1970-01-01")
    _drop_partitions(spark, table, dated.select(_spec(F.col("part_name")).alias("spec")), at_once)
    return add_partitions(spark, table, latest)


def analyze(
    spark: SparkSession, table: str, columns: list[str] | None = None, partition: str | None = None
) -> None:
    """Statistics in the catalog: of columns, of one partition spec, or row counts."""
    part = f" PARTITION ({partition})" if partition else ""
    of = f" FOR COLUMNS {', '.join(columns)}" if columns else ""
    spark.sql(f"ANALYZE TABLE {table}{part} COMPUTE STATISTICS{of}")


def repoint_table(spark: SparkSession, table: str, location: str) -> None:
    escaped = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{escaped}'")
    spark.catalog.refreshTable(table)
