"""Joins on keys that may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One task should not be handed more rows of one key than this.
ROWS_PER_KEY = 5_000_000


def join_salted(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    rows_per_key: int = ROWS_PER_KEY,
) -> DataFrame:
    """Join whose left keys above `rows_per_key` rows are spread over as many tasks as their rows ask for.

    Only the right rows of those keys are repeated. The list of such keys has
    at most rows / rows_per_key entries, which bounds its broadcast.
    """
    crowded = (
        left.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_key)
        .select(*on, F.ceil(F.col("_n") / rows_per_key).cast("int").alias("_salts"))
    )
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("_salts")).cast("int")
    left_salted = left.join(F.broadcast(crowded), on, "left").withColumn(
        "_salt", F.coalesce(spread, F.lit(0))
    ).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right_salted = (
        right.join(F.broadcast(crowded), on, "left")
        .withColumn("_salt", F.explode(every))
        .drop("_salts")
    )
    return left_salted.join(right_salted, [*on, "_salt"], how).drop("_salt")


def attach_rows(parents: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Left join of unique parents to their rows when one parent may own most rows.

    The outer join cannot split its right side, so the owned rows look up their
    parent by an inner join and the parents without rows are added.
    """
    found = rows.join(parents, on, "inner")
    lone = parents.join(rows.select(*on).distinct(), on, "left_anti")
    columns = parents.columns + [c for c in rows.columns if c not in on]
    return found.select(*columns).unionByName(lone, allowMissingColumns=True)
