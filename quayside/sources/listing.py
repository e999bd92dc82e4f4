"""Files as storage has them, against those that manifests and registrations name.

A listing reads names, sizes and times; no file is opened.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.objects import path_value, unescaped


def scan_listing(spark: SparkSession, paths: str | list[str], path_keys: list[str] | None = None) -> DataFrame:
    """One row per file below `paths`: `path` (encoded, one slash behind its scheme), `file_name`, `file_size`,
    `modified`, and values of `path_keys`.

    Folders and files that begin with `_` or `.` are left out, as scans leave them out.
    Readers pass over files without a byte; the reader's index, which the driver holds
    anyway, knows their names, and they have size 0 and no time.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    names = pa.table({"path": pa.array(read.inputFiles(), pa.string())})
    sizes = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")
    )
    # The two spell the root of a path with one slash or three.
    plain = F.regexp_replace("path", "^([^:/]+):/+", "$1:/")
    listed = spark.createDataFrame(names).select(plain.alias("path")).join(sizes.withColumn("path", plain), "path", "left")
    values = [path_value(F.col("path"), k).alias(k.lower().replace("-", "_")) for k in path_keys or []]
    return listed.select(
        "path", unescaped(F.substring_index("path", "/", -1)).alias("file_name"),
        F.coalesce("file_size", F.lit(0).cast("long")).alias("file_size"), "modified", *values,
    )


def file_differences(listed: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Files by `keys` with the size they have and the one they should have: `same`, `resized`, `empty`, `missing`, `extra`.

    `declared` has `keys` and `file_size`, null where no size was told; a file declared
    several times should have the greatest. An empty file is told as such unless it
    should be.
    """
    wanted = declared.groupBy(*keys).agg(F.max("file_size").alias("declared_size"), F.lit(True).alias("_declared"))
    found = listed.groupBy(*keys).agg(F.max("file_size").alias("file_size"), F.lit(True).alias("_listed"))
    state = (
        F.when(F.col("_declared").isNull(), "extra")
        .when(F.col("_listed").isNull(), "missing")
        .when((F.col("file_size") == 0) & (F.coalesce("declared_size", F.lit(1)) != 0), "empty")
        .when(F.col("file_size") != F.col("declared_size"), "resized")
        .otherwise("same")
    )
    return found.join(wanted, keys, "full").select(*keys, "file_size", "declared_size", state.alias("state"))


def partition_differences(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per partition, how many of its files are in each state, and whether it is `whole`."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("same", "resized", "empty", "missing", "extra")]
    return files.groupBy(*keys).agg(*counts, (F.count_if(F.col("state") != "same") == 0).alias("whole"))
