"""Column statistics as states that merge, kept per partition.

A state holds what a profile needs of one column in one group: bounds in the
column's own type, counts, sums of lengths, a sketch of its distinct values and,
for numbers, one of their distribution. States of partitions merge to those of
any coarser group, so a new partition is scanned once, by itself, and the table's
statistics never scan the others. One aggregation makes the states of all columns;
no row is repeated per column.

Distinct values are a HyperLogLog sketch over 64-bit hashes: with 2^12 registers
its standard error is 1.6 %, merged or not. Quantiles come from a KLL sketch whose
ranks are off by less than 1.7 % at its default size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.profile import is_ordered

REGISTER_BITS = 12
STATES, ROWS = "column_states", "row_count"
_TEXT = (T.StringType, T.VarcharType, T.CharType)


def _measures(name: str, kind: T.DataType) -> Column:
    """State of a column over the rows of a group; parts that don't apply to its type are left out."""
    c = F.col(f"`{name}`")
    parts = [F.count_if(c.isNull()).alias("nulls")]
    if is_ordered(kind):
        parts.append(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), REGISTER_BITS).alias("distincts"))
    if isinstance(kind, _TEXT):
        parts += [F.sum(F.length(c)).alias("chars"), F.max(F.length(c)).cast("long").alias("longest")]
    elif isinstance(kind, T.BooleanType):
        parts += [F.count_if(c).alias("trues"), F.count_if(~c).alias("falses")]
    elif is_ordered(kind):
        parts += [F.min(c).alias("low"), F.max(c).alias("high")]
    if isinstance(kind, T.NumericType):
        number = c.cast("double")
        parts.append(F.kll_sketch_agg_double(F.when(~F.isnan(number), number)).alias("ranks"))
    return F.struct(*parts).alias(name)


_MERGES = {
    "distincts": F.hll_union_agg, "chars": F.sum, "longest": F.max, "trues": F.sum, "falses": F.sum,
    "low": F.min, "high": F.max, "ranks": F.kll_merge_agg_double,
}


def column_states(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per group: `by`, `row_count`, and `column_states` with a state for each column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    states = F.struct(*[_measures(c, types[c]) for c in columns])
    return df.groupBy(*by or []).agg(F.count(F.lit(1)).alias(ROWS), states.alias(STATES))


def merged_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States of coarser groups from those of finer ones, in the same form.

    A column that a state lacks, as its partition is older, is null in all its rows.
    """
    merged = []
    for field in states.schema[STATES].dataType.fields:
        at = F.col(f"{STATES}.`{field.name}`")
        parts = [F.sum(F.coalesce(at["nulls"], F.col(ROWS))).alias("nulls")]
        parts += [_MERGES[p](at[p]).alias(p) for p in field.dataType.fieldNames() if p != "nulls"]
        merged.append(F.struct(*parts).alias(field.name))
    return states.groupBy(*by or []).agg(F.sum(ROWS).alias(ROWS), F.struct(*merged).alias(STATES))


def profile_of_states(states: DataFrame, by: list[str] | None = None, quantiles: list[float] | None = None) -> DataFrame:
    """The profile as `column_profile` gives it, one row per group and column.

    With `quantiles`, also the values at those ranks, null for what is no number. A
    state of no rows has no bounds, and its quantiles are null.
    """
    none = F.lit(None)
    rows = []
    for field in states.schema[STATES].dataType.fields:
        at, has = F.col(f"{STATES}.`{field.name}`"), set(field.dataType.fieldNames())

        def part(name: str, kind: str, has: set[str] = has, at: Column = at) -> Column:
            return at[name].cast(kind) if name in has else none.cast(kind)

        filled = F.col(ROWS) - at["nulls"]
        length = at["chars"] / F.nullif(filled, F.lit(0)) if "chars" in has else none
        measures = [
            F.lit(field.name).alias("column_name"), part("low", "string").alias("low"), part("high", "string").alias("high"),
            at["nulls"].alias("nulls"),
            (F.hll_sketch_estimate(at["distincts"]) if "distincts" in has else none.cast("long")).alias("distincts"),
            length.cast("double").alias("avg_length"), part("longest", "long").alias("max_length"),
            part("trues", "long").alias("trues"), part("falses", "long").alias("falses"),
        ]
        if quantiles:
            held = F.kll_sketch_get_n_double(at["ranks"]) > 0 if "ranks" in has else F.lit(False)
            found = F.array(*[F.kll_sketch_get_quantile_double(at["ranks"], F.lit(q)) for q in quantiles]) if "ranks" in has else none
            measures.append(F.when(held, found).otherwise(none.cast("array<double>")).alias("quantiles"))
        rows.append(F.struct(*measures))
    return states.select(*by or [], F.inline(F.array(*rows)))


def save_states(states: DataFrame, path: str, by: list[str]) -> None:
    """Keep the states of partitions, replacing those saved before of the same partitions only."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def saved_states(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """All states below `path`; `types` declares the partition columns they are kept by.

    Columns may differ from partition to partition.
    """
    read = spark.read.option("mergeSchema", "true").parquet(path)
    return read.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()], ROWS, STATES)
