"""Spans of days per key: what they cover, where they overlap, what they leave out.

A span has `first_day` and `last_day`, both included. Spans are swept by their
ends, so rows grow with spans and never with days. Ends of a key that fall on one
day are added up before the shuffle, which leaves a key two rows per span at most
and one per day, however many spans it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import partitions as pv
from quayside.operators.asof import as_of_join

SPAN = ["first_day", "last_day"]


def value_spans(items: DataFrame, keep: list[str]) -> DataFrame:
    """Spans that the `partition_values` of items name: ranges, members of lists, single days.

    A range that does not run forward stands for its end. What is no date names no span;
    `other_values` has it.
    """
    return _members(items, keep).select(*keep, "first_day", "last_day").where("last_day is not null")


def other_values(items: DataFrame, keep: list[str]) -> DataFrame:
    """The values of items that are no dates, one row each."""
    return _members(items, keep).where("last_day is null").select(*keep, F.col("last").alias("partition_value"))


def _members(items: DataFrame, keep: list[str]) -> DataFrame:
    values = F.col("partition_values")
    ends = F.split(values, pv.RANGE)
    single = lambda v: F.struct(v.alias("first"), v.alias("last"))
    listed = F.transform(F.split(F.rtrim(values, F.lit(pv.LIST)), pv.LIST), single)
    named = (
        F.when(values.contains(pv.RANGE), F.array(F.struct(F.get(ends, 1).alias("first"), F.get(ends, 0).alias("last"))))
        .when(values.contains(pv.LIST), listed)
        .otherwise(F.array(single(values)))
    )
    opened = items.select(*keep, F.inline(named))
    last = F.col("last").try_cast("date")
    first = F.least(F.coalesce(F.col("first").try_cast("date"), last), last)
    return opened.withColumn("last_day", last).withColumn("first_day", F.when(F.col("first") < F.col("last"), first).otherwise(last))


def swept(spans: DataFrame, keys: list[str], others: DataFrame | None = None) -> DataFrame:
    """Pieces of each key between the ends of its spans, with `depth`, how many spans cover them.

    With `others`, their `other_depth` too. Pieces that nothing covers lie between covered ones.
    """

    def ends(side: DataFrame, depth: str) -> DataFrame:
        forward = side.where("first_day <= last_day")
        end = F.explode(F.array(
            F.struct(F.col("first_day").alias("day"), F.lit(1).alias("step")),
            F.struct(F.date_add("last_day", 1).alias("day"), F.lit(-1).alias("step")),
        ))
        return forward.select(*keys, end.alias("end")).select(*keys, "end.day", F.col("end.step").alias(depth))

    both = ends(spans, "depth")
    steps = ["depth"]
    if others is not None:
        both = both.unionByName(ends(others, "other_depth"), allowMissingColumns=True)
        steps.append("other_depth")
    turns = both.groupBy(*keys, "day").agg(*[F.sum(F.coalesce(s, F.lit(0))).alias(s) for s in steps])
    along = Window.partitionBy(*keys).orderBy("day")
    pieces = turns.select(
        *keys, F.col("day").alias("first_day"), F.date_sub(F.lead("day").over(along), 1).alias("last_day"),
        *[F.sum(s).over(along).cast("long").alias(s) for s in steps],
    )
    return pieces.where("last_day is not null")


def joined_up(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of a key that follow each other without a day between, as one span each."""
    along = Window.partitionBy(*keys).orderBy("first_day")
    opens = F.coalesce(F.date_add(F.lag("last_day").over(along), 1) < F.col("first_day"), F.lit(True))
    number = F.sum(F.col("opens").cast("int")).over(along)
    return (
        pieces.select(*keys, *SPAN, opens.alias("opens")).withColumn("number", number)
        .groupBy(*keys, "number").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")).drop("number")
    )


def _where(pieces: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    return joined_up(pieces.where(wanted), keys)


def covered(spans: DataFrame, keys: list[str], at_least: int = 1) -> DataFrame:
    """Days that `at_least` so many spans cover, as spans apart from each other; two for overlaps."""
    return _where(swept(spans, keys), keys, F.col("depth") >= at_least)


def gaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Days between a key's first and last span that none covers."""
    return _where(swept(spans, keys), keys, F.col("depth") == 0)


def common(spans: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Days that both cover."""
    return _where(swept(spans, keys, others), keys, (F.col("depth") > 0) & (F.col("other_depth") > 0))


def without(spans: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Days that `spans` cover and `others` don't."""
    return _where(swept(spans, keys, others), keys, (F.col("depth") > 0) & (F.col("other_depth") == 0))


def inside(rows: DataFrame, day: Column, spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` with a column `name`: whether a span of their key covers their day.

    Spans of a key are joined up, so of those that begin by then only the last can.
    """
    apart = covered(spans, keys)
    found = as_of_join(rows, apart.withColumnRenamed("last_day", "_until"), keys, day, F.col("first_day"), ["_until"])
    return found.withColumn(name, F.coalesce(day <= F.col("_until"), F.lit(False))).drop("_until")
