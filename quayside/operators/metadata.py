"""Business names, descriptions and tags attached to objects and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.joins import attach_rows


def described_columns(format_columns: DataFrame, business_columns: DataFrame) -> DataFrame:
    """Schema columns with the business name and description given to them."""
    given = business_columns.select(
        "namespace",
        "object_name",
        F.col("schema_column_name").alias("name"),
        "business_name",
        F.col("description").alias("business_description"),
    )
    return format_columns.join(given, ["namespace", "object_name", "name"], "left")


def tagged_objects(objects: DataFrame, tags: DataFrame) -> DataFrame:
    """Objects with their tags, one row each; an object without tags stays."""
    return attach_rows(objects, tags, ["namespace", "object_name"])
