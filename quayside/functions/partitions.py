"""Decoding and spelling of partition values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A date range is written end first, a list with commas, the
# sub-partitions of one partition with colons; an unpartitioned object has the
# key `partition` and the value `none`.
RANGE = "__"
LIST = ","
SUB = ":"
UNPARTITIONED_KEY = "partition"
UNPARTITIONED_VALUE = "none"


def days_between(start: Column, end: Column) -> Column:
    """Every day from `start` up to but not including `end`; none if reversed."""
    return F.when(start < end, F.sequence(start, F.date_sub(end, 1))).otherwise(
        F.array().cast("array<date>")
    )


def expanded_values(values: Column) -> Column:
    """`end__start` to its days, a comma list to its items, else the value itself.

    A range that does not run forward stands for its end alone.
    """
    ends = F.split(values, RANGE)
    end_text = F.get(ends, 0)
    start, end = F.get(ends, 1).try_cast("date"), end_text.try_cast("date")
    days = F.transform(days_between(start, end), lambda d: d.cast("string"))
    return (
        F.when(
            values.contains(RANGE),
            F.concat(F.coalesce(days, F.array().cast("array<string>")), F.array(end_text)),
        )
        .when(values.contains(LIST), F.split(F.rtrim(values, F.lit(LIST)), LIST))
        .otherwise(F.array(values))
    )


def sub_values(values: Column) -> Column:
    """Values of a partition and its sub-partitions, null where there are none."""
    return F.when(values.contains(SUB), F.split(F.rtrim(values, F.lit(SUB)), SUB))


def sub_partition_map(keys: Column, values: Column) -> Column:
    """Partition keys in schema order paired with as many values as are given."""
    return F.map_from_arrays(F.slice(keys, 1, F.size(values)), values)


def stats_keys(key_values: Column, partition_key: Column) -> Column:
    has_map = F.coalesce(F.size(key_values) > 0, F.lit(False))
    return F.when(has_map, F.array_join(F.map_keys(key_values), LIST)).otherwise(partition_key)


def stats_values(key_values: Column, wf_type: Column, partition_key: Column, value: Column) -> Column:
    has_map = F.coalesce(F.size(key_values) > 0, F.lit(False))
    partitioned_singleton = (wf_type == 1) & (F.lower(partition_key) != UNPARTITIONED_KEY)
    return (
        F.when(has_map, F.array_join(F.map_values(key_values), LIST))
        .when(partitioned_singleton, F.lit(""))
        .otherwise(value)
    )


def stats_partition_spec(partition_key: Column, partition_value: Column) -> Column:
    """Partition clause of a statistics request; the first matching rule wins."""
    pairs = F.arrays_zip(
        F.split(partition_key, LIST).alias("k"), F.split(partition_value, LIST).alias("v")
    )
    listed = F.array_join(
        F.transform(pairs, lambda p: F.format_string("`%s`='%s'", p["k"], p["v"])), LIST
    )
    return (
        F.when(
            partition_value.isNull() | (partition_value == ""),
            F.format_string("`%s`", partition_key),
        )
        .when(F.lower(partition_key) == UNPARTITIONED_KEY, F.lit(UNPARTITIONED_VALUE))
        .when(partition_key.contains(LIST) & partition_value.contains(LIST), listed)
        .otherwise(F.format_string("`%s`='%s'", partition_key, partition_value))
    )


def quoted_keys(keys: Column) -> Column:
    return F.array_join(F.transform(keys, lambda k: F.concat(F.lit("`"), k, F.lit("`"))), LIST)


def canonical_partition(spec: Column) -> Column:
    """`(K='v', K2='v2')` to `k=v/k2=v2`.

    The kept characters include everything between comma and equals sign, so
    digits and `. / : ; <` survive.
    """
    kept = F.rtrim(F.regexp_replace(spec, "[^a-zA-Z0-9,-=_]", ""), F.lit(LIST))

    def lower_key(part: Column) -> Column:
        key, value = F.substring_index(part, "=", 1), F.substring_index(part, "=", -1)
        one_pair = (F.concat(key, F.lit("="), value) == part) & (value != "")
        return F.when(one_pair, F.concat(F.lower(key), F.lit("="), value)).otherwise(part)

    return F.array_join(F.transform(F.split(kept, LIST), lower_key), "/")


def quoted(value: Column) -> Column:
    """A text as a literal of a statement."""
    return F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def add_partition_text(table: Column, spec: Column, location: Column) -> Column:
    return F.format_string(
        "ALTER TABLE `%s` ADD IF NOT EXISTS PARTITION %s LOCATION %s;", table, spec, quoted(location)
    )


def drop_partition_text(table: Column, spec: Column) -> Column:
    return F.format_string("ALTER TABLE `%s` DROP IF EXISTS PARTITION %s;", table, spec)


def move_partition_text(table: Column, spec: Column, location: Column) -> Column:
    return F.format_string("ALTER TABLE `%s` PARTITION %s SET LOCATION %s;", table, spec, quoted(location))


def is_date_key(partition_columns: Column, partition_key: Column) -> Column:
    """True where the schema types the key as a date.

    `partition_columns` is an array of structs with `name` and `type`.
    """
    return F.exists(
        partition_columns,
        lambda c: (F.lower(c["name"]) == F.lower(partition_key)) & (F.upper(c["type"]) == "DATE"),
    )


def short_list(values: Column, shown: int = 5) -> Column:
    """The first few items of a comma list and an ellipsis; else the value."""
    head = F.array_join(F.slice(F.split(values, LIST), 1, shown), LIST)
    return F.when(values.contains(LIST), F.concat(head, F.lit("..."))).otherwise(values)
