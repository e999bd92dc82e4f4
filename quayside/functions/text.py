"""Rendering of rows, failures and subjects as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.partitions import short_list
from quayside.functions.workflow import action_label


def delimited_row(columns: list[Column], delimiter: str = ",") -> Column:
    """All values as text, missing ones as the word null, joined."""
    return F.concat_ws(delimiter, *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])


def rendered(df: DataFrame, delimiter: str = ",") -> DataFrame:
    return df.select(delimited_row([F.col(f"`{c}`") for c in df.columns], delimiter).alias("line"))


def failure_subject(wf_type: Column, attempts: Column) -> Column:
    return F.format_string("%s Failed After %d Retries", action_label(wf_type), attempts)


def full_subject(subject: Column, *key_parts: Column, partition_values: Column) -> Column:
    return F.concat(
        subject, F.lit(" for "), F.concat_ws("-", *key_parts, short_list(partition_values))
    )


def failure_body(
    cluster_id: Column, execution_id: Column, partition_values: Column, error: Column
) -> Column:
    head = F.format_string("Cluster ID = %s, Execution ID = %s \n ", cluster_id, execution_id)
    listed = F.format_string("Partition Values: %s \n\n %s", partition_values, error)
    return F.concat(head, F.when(partition_values.contains(","), listed).otherwise(error))
