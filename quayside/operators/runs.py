"""Greedy runs over an order: rows add up until a limit, then the count restarts.

The restart makes this no window sum, and one key may own a third of the rows,
so no task may see a whole key. The rows are range-partitioned by key and order
and written once. A partition that lies inside one key reports what it does to
the possible entering weights, as pieces: neighbouring weights with one outcome
are one piece, and after a restart most outcomes are the same. The reports, one
per partition, chain on the driver; then every partition numbers its rows from
its entering state.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.session import stable_in_place

# Tasks get the helpers below by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_REPORT = (
    "part int, first_key string, last_key string, piece array<long>, leaving array<long>, closed array<long>, kept string"
)
_REPORT_BATCH = pa.schema(
    [
        ("part", pa.int32()),
        ("first_key", pa.string()),
        ("last_key", pa.string()),
        ("piece", pa.list_(pa.int64())),
        ("leaving", pa.list_(pa.int64())),
        ("closed", pa.list_(pa.int64())),
        ("kept", pa.string()),
    ]
)


def _segments(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    """Where each key's rows begin and end in a batch sorted by key."""
    size = batch.num_rows
    change = np.zeros(size - 1, dtype=bool)
    for name in keys:
        one, next_one = batch[name].slice(0, size - 1), batch[name].slice(1)
        differs = pc.fill_null(pc.not_equal(one, next_one), False)
        change |= _numbers(differs) | (_numbers(one.is_null()) != _numbers(next_one.is_null()))
    starts = [0, *(np.flatnonzero(change) + 1).tolist()]
    return list(zip(starts, [*starts[1:], size]))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _key_at(batch: pa.RecordBatch, keys: list[str], at: int) -> tuple:
    return tuple(batch[name][at].as_py() for name in keys)


def _passed(entering: np.ndarray, weights: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaving weight and closed runs for each entering weight."""
    sums = np.cumsum(weights)
    base, closed = -entering, np.zeros(len(entering), dtype=np.int64)
    at = np.searchsorted(sums, base + limit)
    while (inside := at < len(sums)).any():
        base[inside] = sums[at[inside]]
        closed[inside] += 1
        at[inside] = np.searchsorted(sums, base[inside] + limit)
    return sums[-1] - base, closed


def _latest_kept(values: pa.Array, kept: np.ndarray, begin: int, end: int, before: str | None):
    at = np.flatnonzero(kept[begin:end])
    return values[begin + int(at[-1])].as_py() if len(at) else before


def number_runs(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    weight: str,
    limit: int,
    value: str,
    keep: str,
    partitions: int | None = None,
) -> DataFrame:
    """Add `run_no`, `run_closed` and `previous` to each row.

    A run closes with the row that brings its weight to `limit` or more.
    `previous` is `value` of the latest row in front, within the key, whose
    `keep` holds; rows without `keep` still weigh.
    """
    spark, given = df.sparkSession, df.columns
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stable_in_place(
        df.repartitionByRange(count, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
    )

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = current = part = kept = leaving = closed = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["_part"][0].as_py()
            first = _key_at(batch, keys, 0) if first is None else first
            # What a partition hands on depends on its last key alone.
            begin, end = _segments(batch, keys)[-1]
            key = _key_at(batch, keys, begin)
            if key != current:
                # Its first key may enter with any weight, a later one with none.
                leaving = np.arange(limit if key == first else 1, dtype=np.int64)
                closed, kept, current = np.zeros(len(leaving), dtype=np.int64), None, key
            leaving, more = _passed(leaving, _numbers(batch[weight])[begin:end], limit)
            closed += more
            kept = _latest_kept(batch[value], _numbers(batch[keep]), begin, end, kept)
        if current is not None:
            names = [json.dumps(k, default=str) for k in (first, current)]
            pieces = np.flatnonzero(np.concatenate([[True], (np.diff(leaving) != 0) | (np.diff(closed) != 0)]))
            row = {"part": part, "first_key": names[0], "last_key": names[1], "piece": pieces.tolist(),
                   "leaving": leaving[pieces].tolist(), "closed": closed[pieces].tolist(), "kept": kept}
            yield pa.RecordBatch.from_pylist([row], schema=_REPORT_BATCH)

    narrow = ordered.select(*dict.fromkeys([*keys, weight, value, keep, "_part"]))
    reports = sorted(narrow.mapInArrow(report, _REPORT).collect(), key=lambda r: r.part)

    entering: dict[int, tuple[int, int, str | None]] = {}
    key, state = None, (0, 0, None)
    for r in reports:
        begin = state if r.first_key == key else (0, 0, None)
        entering[r.part] = begin
        inside = r.first_key == r.last_key
        at, runs, kept = begin if inside else (0, 0, None)
        piece = bisect_right(r.piece, at) - 1
        state = (r.leaving[piece], runs + r.closed[piece], r.kept if r.kept is not None else kept)
        key = r.last_key

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        total, run, kept = 0, 0, None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            sums = np.cumsum(_numbers(batch[weight]), dtype=np.int64).tolist()
            values, keeps = batch[value], _numbers(batch[keep])
            numbers, ends = np.empty(size, dtype=np.int64), np.zeros(size, dtype=bool)
            # Row of the latest kept value up to each row, -1 before any.
            latest = np.maximum.accumulate(np.where(keeps, np.arange(size), -1))
            before, carried = np.empty(size, dtype=np.int64), None
            for begin, end in _segments(batch, keys):
                key = _key_at(batch, keys, begin)
                if key != current:
                    fresh = current is not None
                    total, run, kept = (0, 0, None) if fresh else entering[batch["_part"][0].as_py()]
                    current = key
                if begin == 0:
                    carried = kept
                base, at = (sums[begin - 1] if begin else 0) - total, begin
                while (cut := bisect_left(sums, base + limit, at, end)) < end:
                    numbers[at : cut + 1], ends[cut] = run, True
                    base, at, run = sums[cut], cut + 1, run + 1
                numbers[at:end] = run
                total = sums[end - 1] - base
                # Only a batch's first key can bring a value along, kept behind its rows.
                earlier = -1 if kept is None else size
                before[begin] = earlier
                inner = latest[begin : end - 1]
                before[begin + 1 : end] = np.where(inner >= begin, inner, earlier)
                kept = _latest_kept(values, keeps, begin, end, kept)
            pool = pa.concat_arrays([values, pa.array([carried], values.type)])
            previous = pool.take(pa.array(before, mask=before < 0))
            yield pa.RecordBatch.from_arrays(
                [*[batch[name] for name in given], pa.array(numbers), pa.array(ends), previous],
                names=[*given, "run_no", "run_closed", "previous"],
            )

    out = T.StructType(
        df.schema.fields
        + [
            T.StructField("run_no", T.LongType()),
            T.StructField("run_closed", T.BooleanType()),
            T.StructField("previous", T.StringType()),
        ]
    )
    return ordered.mapInArrow(number, out)
