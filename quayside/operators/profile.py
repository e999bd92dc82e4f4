"""Column profiles, row counts and their reconciliation with manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_ordered(kind: T.DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, T.ArrayType):
        return is_ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(is_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def column_profile(
    df: DataFrame, columns: list[str], by: list[str] | None = None, exact: bool = False
) -> DataFrame:
    """One row per column, and per group if `by` is given.

    Bounds, nulls, distinct values, lengths and truth counts of all columns come
    from one aggregation that combines before its shuffle. A type without an order,
    such as a map, has no bounds, and its distinct values are null. Distinct values are
    estimated unless `exact`, which counts them by `distinct_counts`.
    """
    by = by or []
    types = {f.name: f.dataType for f in df.schema.fields}
    measures = []
    none = F.lit(None)
    for name in columns:
        c, kind = F.col(f"`{name}`"), types[name]
        text = isinstance(kind, (T.StringType, T.VarcharType, T.CharType))
        truth = isinstance(kind, T.BooleanType)
        ordered = is_ordered(kind)
        bounded = ordered and not text and not truth
        distinct = F.approx_count_distinct(c) if ordered and not exact else none.cast("long")
        measures.append(
            F.struct(
                F.lit(name).alias("column_name"),
                (F.min(c).cast("string") if bounded else none.cast("string")).alias("low"),
                (F.max(c).cast("string") if bounded else none.cast("string")).alias("high"),
                F.count_if(c.isNull()).alias("nulls"),
                distinct.alias("distincts"),
                (F.avg(F.length(c)) if text else none.cast("double")).alias("avg_length"),
                (F.max(F.length(c)).cast("long") if text else none.cast("long")).alias("max_length"),
                (F.count_if(c) if truth else none.cast("long")).alias("trues"),
                (F.count_if(~c) if truth else none.cast("long")).alias("falses"),
            )
        )
    profiled = df.groupBy(*by).agg(F.array(*measures).alias("_profile")).select(*by, F.inline("_profile"))
    counted = [c for c in columns if is_ordered(types[c])] if exact else []
    if not counted:
        return profiled
    counts = distinct_counts(df, counted, by)
    same = F.col("p.column_name") == F.col("c.column_name")
    for k in by:
        same &= F.col(f"p.`{k}`").eqNullSafe(F.col(f"c.`{k}`"))
    held = F.when(F.col("p.column_name").isin(counted), F.coalesce("c.distincts", F.lit(0)))
    joined = profiled.alias("p").join(counts.alias("c"), same, "left").withColumn("_held", held)
    return joined.select(*[(F.col("_held").alias(n) if n == "distincts" else F.col(f"p.`{n}`")) for n in profiled.columns])


def distinct_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """`column_name` and `distincts`, exact, per group if `by` is given; a column of nulls alone has no row.

    Columns of one type go through one exchange of their values, each once per task, so
    a row is as wide as one value and no set is held.
    """
    by = by or []
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if f.name in columns:
            kinds.setdefault(f.dataType.simpleString(), []).append(f.name)
    found = None
    for names in kinds.values():
        each = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("_value")) for n in names])
        values = df.select(*by, F.inline(each)).where("_value is not null").distinct()
        counted = values.groupBy(*by, "column_name").agg(F.count(F.lit(1)).alias("distincts"))
        found = counted if found is None else found.unionByName(counted)
    return found


def row_counts(scanned: DataFrame, keys: list[str]) -> DataFrame:
    return scanned.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))


def reconciled(counted: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Counted against declared rows; a difference is reported, never an error."""
    promised = declared.groupBy(*keys).agg(F.sum("row_count").alias("declared"))
    both = counted.withColumnRenamed("row_count", "counted").join(promised, keys, "full")
    return both.select(
        *keys,
        "counted",
        "declared",
        F.when(F.col("declared").isNull(), "undeclared")
        .when(F.col("counted").isNull(), "missing")
        .when(F.col("counted") == F.col("declared"), "match")
        .otherwise("mismatch")
        .alias("state"),
    )


def distinct_databases(databases: DataFrame) -> DataFrame:
    return databases.select("db_name").distinct()


def distinct_users(permissions: DataFrame) -> DataFrame:
    """Users with READ on any namespace."""
    return (
        permissions.where(F.array_contains("permissions", "READ")).select("user_id").distinct()
    )
