"""Positions over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.session import stable


def numbered(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Add the one-based position of each row in `order`, which must be total.

    Rows are range-partitioned and sorted where they are; a row's id then holds
    its partition and its place in it. A partition starts at the number of rows
    in front, one number per partition, so nothing is shuffled a second time.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stable(
        df.repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # The lower 33 bits of the id count the rows of a partition.
    part = F.shiftright("_id", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + at).cast("long"))
        .drop("_part", "_id", "_start")
    )
