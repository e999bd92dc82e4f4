"""As-of lookups: for each row the newest entry of its key up to the row's own time.

Both sides become one sequence by key and time, range-partitioned, so a key with a
third of all rows spans as many partitions as its rows ask for. Inside a partition
the last entry is carried on, in one pass over its sorted rows; over the border only
one key can go on, and what it carries is one row per partition.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.session import stable

# Tasks get the helpers below by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ENTRY, _ROW = 0, 1


def _repeats(column: pa.Array) -> np.ndarray:
    """Whether each value is the one in front, as Spark groups: nulls are one value, NaNs too."""
    after, front = column.slice(1), column.slice(0, len(column) - 1)
    if pa.types.is_nested(column.type):
        return np.array([a == b for a, b in zip(after.to_pylist(), front.to_pylist())], dtype=bool)
    same = pc.or_(pc.fill_null(pc.equal(after, front), False), pc.and_(after.is_null(), front.is_null()))
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(after), pc.is_nan(front)), False))
    return same.to_numpy(zero_copy_only=False)


def _carried_on(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition with the last entry of their key in it as `entry`.

    Behind them comes one row of kind entry: the last key with what it leaves.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        place = np.arange(batch.num_rows)
        same = np.ones(batch.num_rows, dtype=bool)
        same[0] = False
        for n in names:
            same[1:] &= _repeats(batch[n])
        begins = np.maximum.accumulate(np.where(same, 0, place))
        last = np.maximum.accumulate(np.where(batch["entry"].is_valid().to_numpy(zero_copy_only=False), place, -1))
        found = batch["entry"].take(pa.array(last, mask=last < begins))
        columns = {name: batch[name] for name in batch.schema.names} | {"entry": found}
        whole = pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
        end = {name: c.slice(len(c) - 1) for name, c in columns.items()}
        end["kind"], end["row"] = pa.array([_ENTRY], columns["kind"].type), pa.nulls(1, columns["row"].type)
        held = pa.RecordBatch.from_arrays(list(end.values()), schema=batch.schema)
        yield whole.filter(pc.equal(whole["kind"], _ROW))
    if held is not None:
        yield held


def as_of_join(
    rows: DataFrame, entries: DataFrame, keys: list[str], row_time: Column, entry_time: Column,
    carry: list[str], partitions: int | None = None,
) -> DataFrame:
    """`rows` with the columns `carry` of the entry whose time is the last one not after the row's.

    Of several entries of a key at one time the greatest `carry` counts, column by
    column. A row without such an entry, without a time or with a null in its key has
    nulls; entries without a time don't count. Both times must be of one type. Rows keep
    all columns; `carry` must not repeat one of their names.
    """
    key = [F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)]
    names = [f"k{n}" for n in range(len(keys))]
    held = F.struct(*[F.col(f"`{c}`") for c in carry])
    known = entries.select(*key, entry_time.alias("time"), held.alias("entry")).where("time is not null")
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    asked = rows.select(*key, row_time.alias("time"), own.alias("row"))
    both = known.withColumn("kind", F.lit(_ENTRY)).unionByName(asked.withColumn("kind", F.lit(_ROW)), allowMissingColumns=True)
    # Of one moment the greatest entry is the last; its rows may be many, and a hash spreads them behind it.
    order = [*names, "time", "kind", "entry"]
    spread = [*order, F.xxhash64(*[F.col(f"row.`{c}`") for c in rows.columns])]
    # Without a number, ranges are put together by their size at run time.
    ranged = both.repartitionByRange(partitions, *spread) if partitions else both.repartitionByRange(*spread)
    ordered = ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    placed = stable(ordered.mapInArrow(lambda batches: _carried_on(batches, names), ordered.schema))

    # What a partition's last key has been left with goes to the next partition that has rows: one row each.
    ends = placed.where(F.col("kind") == _ENTRY)
    so_far = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    entering = ends.select(
        *[F.col(n).alias(f"e{n}") for n in names], F.last("entry", ignorenulls=True).over(so_far).alias("entering"),
        F.lead("part").over(Window.orderBy("part")).alias("at"),
    ).where("entering is not null and at is not null")
    same = F.col("part") == F.col("at")
    for n in names:
        same &= F.col(n) == F.col(f"e{n}")
    whole = F.col("time").isNotNull()
    for n in names:
        whole &= F.col(n).isNotNull()
    value = F.when(whole, F.coalesce("entry", "entering"))
    joined = placed.where(F.col("kind") == _ROW).join(F.broadcast(entering), same, "left").withColumn("value", value)
    return joined.select("row.*", *[F.col(f"value.`{c}`").alias(c) for c in carry])
