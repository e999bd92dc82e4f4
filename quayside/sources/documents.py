"""Manifests, format registrations and registration requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.ordering import numbered

# Field names of the manifest document. A row count may be written
# as a number or as text, so it is read as text.
MANIFEST = (
    "namespace string, businessObjectDefinitionName string, businessObjectFormatUsage string, "
    "businessObjectFormatFileType string, businessObjectFormatVersion string, partitionKey string, "
    "partitionValue string, manifestFiles array<struct<fileName: string, rowCount: string>>"
)

_COLUMN = "struct<name: string, type: string, size: string, required: boolean, description: string>"
# Element names of the format registration document.
FORMAT = (
    "namespace string, businessObjectDefinitionName string, businessObjectFormatUsage string, "
    "businessObjectFormatFileType string, partitionKey string, "
    f"schema struct<columns: struct<column: array<{_COLUMN}>>, partitions: struct<column: array<{_COLUMN}>>, "
    "nullValue: string, delimiter: string, escapeCharacter: string>"
)
FORMAT_ROW = "businessObjectFormatCreateRequest"


def _object_key() -> list:
    return [
        F.col("namespace"),
        F.col("businessObjectDefinitionName").alias("object_name"),
        F.col("businessObjectFormatUsage").alias("usage_code"),
        F.col("businessObjectFormatFileType").alias("file_type"),
    ]


def scan_manifests(spark: SparkSession, path: str, document_per_file: bool = True) -> DataFrame:
    """One row per file a manifest declares."""
    read = spark.read.schema(MANIFEST).option("multiLine", document_per_file).json(path)
    return read.select(
        *_object_key(),
        F.col("businessObjectFormatVersion").try_cast("int").alias("format_version"),
        F.col("partitionKey").alias("partition_key"),
        F.col("partitionValue").alias("partition_value"),
        F.explode("manifestFiles").alias("file"),
    ).select("*", F.col("file.fileName").alias("file_name"),
             F.col("file.rowCount").try_cast("long").alias("row_count")).drop("file")


def _formats(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", FORMAT_ROW).option("nullValue", "")
    return reader.schema(T.StructType.fromDDL(FORMAT)).load(path)


def scan_format_columns(spark: SparkSession, path: str) -> DataFrame:
    """Columns of each registered format, data columns first, by position."""
    read = _formats(spark, path)

    def part(columns: str, is_partition: bool) -> DataFrame:
        return read.select(
            *_object_key(),
            F.lit(is_partition).alias("is_partition"),
            F.posexplode(columns).alias("ordinal", "column"),
        )

    both = part("schema.columns.column", False).unionByName(part("schema.partitions.column", True))
    return both.select(*[c for c in both.columns if c != "column"], "column.*")


def scan_format_marks(spark: SparkSession, path: str) -> DataFrame:
    """Partition key, delimiter, escape and null token of each registered format."""
    return _formats(spark, path).select(
        *_object_key(),
        F.col("partitionKey").alias("partition_key"),
        F.coalesce("schema.delimiter", F.lit("")).alias("delimiter"),
        F.coalesce("schema.escapeCharacter", F.lit("")).alias("escape"),
        F.coalesce("schema.nullValue", F.lit("")).alias("null_token"),
    )


REQUEST_FIELDS = ["namespace", "object_name", "usage_code", "file_type", "workflow", "action", "json_file"]


def parsed_requests(lines: DataFrame) -> DataFrame:
    """Fields of `line`; comments, blank lines and the header are dropped."""
    line = F.col("line")
    skipped = line.rlike(r"^\s*#") | line.rlike(r"^\s*$") | line.rlike(r"^\s*namespace")
    fields = F.split(line, r"\|")
    trimmed = [
        F.coalesce(F.regexp_replace(F.get(fields, at), r"^\s+|\s+$", ""), F.lit("")).alias(name)
        for at, name in enumerate(REQUEST_FIELDS)
    ]
    return lines.where(~skipped).select("*", *trimmed)


def line_numbers(requests: DataFrame) -> DataFrame:
    """Requests numbered from one in the order of their files and lines."""
    return numbered(requests, [F.col("place")], "line_no")


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """Registration requests with their place: file, block and row within it."""
    read = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("place"),
    )
    return parsed_requests(read)
