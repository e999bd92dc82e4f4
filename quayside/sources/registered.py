"""Scans of an object as its registered format describes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.names import OBJECT_KEY
from quayside.operators.partitions import latest_valid
from quayside.schemas import column_type
from quayside.sources.objects import scan_columnar, scan_delimited


def of_object(df: DataFrame, key: tuple[str, str, str, str]) -> DataFrame:
    """Rows of one object."""
    for name, value in zip(OBJECT_KEY, key):
        df = df.where(F.col(name) == value)
    return df


def registered_schema(
    format_columns: DataFrame, key: tuple[str, str, str, str]
) -> tuple[T.StructType, T.StructType]:
    """Data and partition columns of one object, names in lower case.

    A partition column that shares its name with a data column is prefixed.
    """
    data, parts = T.StructType(), T.StructType()
    # The columns of one object: as many rows as it is wide.
    for c in of_object(format_columns, key).orderBy("is_partition", "ordinal").collect():
        name = c["name"].lower()
        if c.is_partition:
            clash = name in data.fieldNames()
            parts.add(f"partition_{name}" if clash else name, column_type(c.type, c["size"]))
        else:
            data.add(name, column_type(c.type, c["size"]))
    return data, parts


def scan_registered(
    spark: SparkSession,
    format_columns: DataFrame,
    format_marks: DataFrame,
    key: tuple[str, str, str, str],
    paths: str | list[str],
) -> DataFrame:
    """All files of an object below `paths`; partition values come from the paths."""
    data, parts = registered_schema(format_columns, key)
    keys = [f.name.removeprefix("partition_") for f in parts.fields]
    if key[3].upper() == "ORC":
        read = scan_columnar(spark, paths, data, nested=True, path_keys=keys)
    else:
        marks = of_object(format_marks, key).first()
        read = scan_delimited(
            spark, paths, data, marks.delimiter, marks.escape, marks.null_token, nested=True, path_keys=keys
        )
    # By position, as a value from the path may share its name with a data column.
    read = read.toDF(*data.fieldNames(), *parts.fieldNames())
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in parts.fields]
    return read.select(*data.fieldNames(), *typed)


def scan_current(
    spark: SparkSession,
    format_columns: DataFrame,
    format_marks: DataFrame,
    key: tuple[str, str, str, str],
    data: DataFrame,
) -> DataFrame:
    """The newest valid version of each of an object's partitions, all stored in one format version.

    `data` is the registered data. The places to read are one per partition of one
    object; Spark lists their files. `versions.scan_versions` reads objects whose
    format has changed.
    """
    places = latest_valid(of_object(data, key)).select("file_path").distinct()
    return scan_registered(spark, format_columns, format_marks, key, [r.file_path for r in places.toLocalIterator()])
