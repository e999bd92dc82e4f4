"""One object stored under several registered formats, read as the newest one declares it.

Each partition keeps the format version it was stored with. ORC files are read
under the names and types of their own version, text, which has none, under the
types of the wanted one; columns then meet by position. So a renamed column keeps
its values, a retyped one is converted, an added one is null in older partitions,
and each stored version is one scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.names import OBJECT_KEY
from quayside.operators.partitions import latest_valid
from quayside.sources.objects import scan_columnar, scan_delimited
from quayside.sources.registered import of_object, registered_schema

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def converted(value: Column, stored: T.DataType, wanted: T.DataType) -> Column:
    """`value` as the wanted type; null where it does not fit."""
    if stored == wanted:
        return value
    dates = isinstance(stored, _DATES), isinstance(wanted, _DATES)
    if dates[0] != dates[1] and not isinstance(stored if dates[1] else wanted, T.StringType):
        # A date is no number and a number no date; the two have no conversion.
        return F.lit(None).cast(wanted)
    return value.try_cast(wanted)


def by_position(stored: list[T.DataType], names: list[str], wanted: T.StructType) -> list[Column]:
    """Stored columns under the names and types of `wanted`; one the data lacks is null."""
    return [
        (converted(F.col(names[at]), stored[at], field.dataType) if at < len(stored) else F.lit(None).cast(field.dataType)).alias(field.name)
        for at, field in enumerate(wanted.fields)
    ]


def unregistered_partitions(data: DataFrame, format_columns: DataFrame) -> DataFrame:
    """The newest valid partitions that are stored under a version nobody registered."""
    known = format_columns.select(*OBJECT_KEY, "format_version").distinct()
    return latest_valid(data).join(known, [*OBJECT_KEY, "format_version"], "left_anti")


def scan_versions(
    spark: SparkSession,
    format_columns: DataFrame,
    format_marks: DataFrame,
    key: tuple[str, str, str, str],
    data: DataFrame,
    version: int | None = None,
) -> DataFrame:
    """The newest valid version of each of an object's partitions, under one format version.

    `format_columns` and `format_marks` have a row set per `format_version`; `version`
    is the highest registered one by default. Partitions of a version without
    registration are an error, told before anything is read; `unregistered_partitions`
    lists them. Values that do not fit a new type are null. Partition columns meet by
    position too. What goes to the driver is one object's columns and the places of
    its partitions, as many as the reader is given to list.
    """
    columns, marks = of_object(format_columns, key), of_object(format_marks, key)
    known = sorted(r.format_version for r in columns.select("format_version").distinct().collect())
    wanted = known[-1] if version is None and known else version
    if wanted not in known:
        raise ValueError(f"{'.'.join(key)} has no registered format version {wanted}")
    places: dict[int, list[str]] = {}
    stored = latest_valid(of_object(data, key)).select("format_version", "file_path").distinct()
    for row in stored.orderBy("format_version", "file_path").toLocalIterator():
        places.setdefault(row.format_version, []).append(row.file_path)
    unknown = {v: len(p) for v, p in places.items() if v not in known}
    if unknown:
        raise ValueError(f"{'.'.join(key)} has partitions of format versions without registration: {unknown}")
    target, target_parts = registered_schema(columns.where(F.col("format_version") == wanted), key)
    read = []
    for stored_version, paths in places.items():
        own = F.col("format_version") == stored_version
        own_data, own_parts = registered_schema(columns.where(own), key)
        keys = [f.name.removeprefix("partition_") for f in own_parts.fields]
        if key[3].upper() == "ORC":
            found, shape = scan_columnar(spark, paths, own_data, nested=True, path_keys=keys), own_data
        else:
            of_version = marks.where(own).first() or marks.where(F.col("format_version") == wanted).first()
            found, shape = scan_delimited(
                spark, paths, target, of_version.delimiter, of_version.escape, of_version.null_token, nested=True, path_keys=keys
            ), target
        # Columns get names of their own, as a value from the path may share its name with a data column.
        values, folders = [f"d{k}" for k in range(len(shape.fields))], [f"p{k}" for k in range(len(keys))]
        found = found.toDF(*values, *folders)
        read.append(found.select(
            *by_position([f.dataType for f in shape.fields], values, target),
            *by_position([T.StringType()] * len(keys), folders, target_parts),
        ))
    if not read:
        return spark.createDataFrame([], T.StructType([*target.fields, *target_parts.fields]))
    return reduce(DataFrame.unionByName, read)
