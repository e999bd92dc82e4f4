"""From a batch of work items to everything a load does, as tables.

Nothing is applied here. The statements, statistics requests and outcomes are
rows; the sinks apply them at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import partitions as pv
from quayside.functions import workflow
from quayside.functions.names import sanitised, table_name
from quayside.operators import evolution
from quayside.operators import partitions as ops
from quayside.operators.work import decoded_items
from quayside.session import stable


# What a table's name is made of, besides the object's key.
NAMED_BY = ("correlation_data",)


@dataclass(frozen=True)
class Load:
    """`statements` by `id`, `step`, `ordinal`; `stats` as new work items; `left_out` says what no statement adds.

    `left_out` has `id`, `table_name`, `partition_value`, `sub_partition_values` and `reason`.
    """

    statements: DataFrame
    stats: DataFrame
    left_out: DataFrame


# Why a partition gets no statement.
NO_FORMAT, TOO_DEEP, NO_DATA = "no registered format", "more levels than keys", "no registered data"


def _numbered(step: int, ordinal: Column, statement: Column) -> list[Column]:
    return [
        F.col("id"),
        F.lit(step).alias("step"),
        ordinal.cast("int").alias("ordinal"),
        statement.alias("statement"),
    ]


def named_items(items: DataFrame, existing_tables: DataFrame) -> DataFrame:
    """Work items by the names of their tables and databases; `_exists` tells whether `existing_tables` has the table."""
    decoded = decoded_items(items).join(
        existing_tables.select("table_name", F.lit(True).alias("_exists")).distinct(), "table_name", "left"
    ).withColumn("_exists", F.coalesce("_exists", F.lit(False)))
    # Five kinds of statements start from the names, so they are made once.
    return stable(
        decoded.select(
            "id", "table_name", "database_name", "file_type", "wf_type", "partition_key", "_exists"
        )
    )


def schema_statements(named: DataFrame, old_columns: DataFrame, new_columns: DataFrame) -> DataFrame:
    """Steps 0 and 1 of loads of `named_items`: databases, then columns. No registered data is looked at."""
    database = F.explode(
        F.array(
            F.struct(F.lit(0).alias("at"), F.format_string("CREATE DATABASE IF NOT EXISTS %s;", F.col("database_name")).alias("text")),
            F.struct(F.lit(1).alias("at"), F.format_string("use %s;", F.col("database_name")).alias("text")),
        )
    )
    opening = named.select("id", database.alias("s")).select(
        *_numbered(0, F.col("s.at"), F.col("s.text"))
    )

    present = named.where("_exists")
    changes = evolution.column_changes(old_columns, new_columns)
    unpartitioned = workflow.is_unpartitioned_singleton(F.col("wf_type"), F.col("partition_key"))
    evolving, replaced = present.where(~unpartitioned), present.where(unpartitioned)
    # The file type is part of a table's name; the rest of its plan is the same for all items.
    kinds = evolving.select(
        "table_name", "file_type", F.lit(workflow.MANAGED).alias("wf_type"), F.lit("").alias("partition_key")
    ).distinct()
    planned = evolution.change_plan(kinds, changes, new_columns)
    schema = evolving.select("id", "table_name").join(planned, "table_name").select(
        *_numbered(1, F.col("step") * 10_000 + F.col("ordinal"), F.col("statement"))
    )
    anew = replaced.select("id", "table_name").join(
        evolution.replacements(new_columns, cascade=False), "table_name"
    ).select(*_numbered(1, F.lit(0), F.col("statement")))
    return opening.unionByName(schema).unionByName(anew)


def load(
    items: DataFrame,
    data: DataFrame,
    existing_tables: DataFrame,
    old_columns: DataFrame,
    new_columns: DataFrame,
    as_of_date: Column,
) -> Load:
    """What the items' loads do.

    `items` carry `attempts`; `data` holds the latest valid partitions;
    `existing_tables` lists `table_name`. A table is created by its first load,
    so only an existing one gets schema changes, or has its singleton replaced.
    """
    named = named_items(items, existing_tables)
    schema = schema_statements(named, old_columns, new_columns)

    # Partition columns as they are registered for the object, in order; its table may have another name.
    registered = (
        new_columns.where("is_partition").groupBy(F.col("table_name").alias("_own"))
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).getField("name").alias("keys"))
    )
    # Met by partitions that are added and by places of tables without any, so found once.
    selected = stable(ops.selected_partitions(items, data, as_of_date, carry=["partition_key", "wf_type", *NAMED_BY]).withColumn(
        "table_name", table_name(F.col("object_name"), F.col("usage_code"), F.col("file_type"), F.col("correlation_data"))
    ).withColumn("_own", sanitised(F.concat_ws("_", "object_name", "usage_code", "file_type"))))
    unkeyed = workflow.is_unpartitioned_singleton(F.col("wf_type"), F.col("partition_key"))
    dropping = named.where(
        F.col("_exists") & workflow.is_partitioned_singleton(F.col("wf_type"), F.col("partition_key"))
    ).select(
        *_numbered(
            2,
            F.lit(0),
            F.format_string(
                "alter table %s drop if exists partition (%s >'1970-01-01');",
                F.col("table_name"), F.col("partition_key"),
            ),
        )
    )
    values = F.concat(
        F.array("partition_value"),
        F.coalesce("sub_partition_values", F.array().cast("array<string>")),
    )
    pairs = F.transform(
        F.arrays_zip(F.slice("keys", 1, F.size(values)).alias("k"), values.alias("v")),
        lambda p: F.concat(p["k"], F.lit("="), pv.quoted(p["v"])),
    )
    spec = F.concat(F.lit("("), F.array_join(pairs, ", "), F.lit(")"))
    # A partition registered anew is dropped first, else it would keep its old place.
    both = F.explode(F.array(
        F.struct(F.lit(0).alias("at"), pv.drop_partition_text(F.col("table_name"), spec).alias("text")),
        F.struct(F.lit(1).alias("at"), pv.add_partition_text(F.col("table_name"), spec, F.col("file_path")).alias("text")),
    ))
    reason = F.when(F.col("keys").isNull(), NO_FORMAT).when(F.size("keys") < F.size(values), TOO_DEEP)
    judged = selected.where(~unkeyed).join(registered, "_own", "left").withColumn("reason", reason)
    adding = (
        judged.where("reason is null").select("id", both.alias("s")).select(*_numbered(3, F.col("s.at"), F.col("s.text")))
    )
    lacking = ops.unavailable_partitions(items, data).join(named.select("id", "table_name"), "id").select(
        "id", "table_name", "partition_value", F.lit(None).cast("array<string>").alias("sub_partition_values"), F.lit(NO_DATA).alias("reason")
    )
    left_out = judged.where("reason is not null").select(
        "id", "table_name", "partition_value", "sub_partition_values", "reason"
    ).unionByName(lacking)
    # A table without partitions has one place: of several files the last.
    placing = (
        selected.where(unkeyed).groupBy("id", "table_name").agg(F.max("file_path").alias("file_path"))
        .select(*_numbered(3, F.lit(0), F.format_string(
            "alter table %s SET LOCATION %s;", F.col("table_name"), pv.quoted(F.col("file_path")))))
    )
    sub_keys = F.split("partition_key", ",")
    stats_items = items.withColumn(
        "key_values", pv.sub_partition_map(sub_keys, pv.sub_values(F.col("partition_values")))
    )
    return Load(
        schema.unionByName(dropping).unionByName(adding).unionByName(placing),
        ops.stats_requests(stats_items),
        left_out,
    )
