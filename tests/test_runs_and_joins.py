from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators.joins import attach_rows, join_salted
from quayside.operators.ordering import numbered
from quayside.operators.runs import number_runs


def folded(rows, limit):
    """Plain fold over sorted (key, value, weight, keep) rows."""
    out, current = [], object()
    for key, value, weight, keep in sorted(rows):
        if key != current:
            current, total, run, before = key, 0, 0, None
        total += weight
        closed = total >= limit
        out.append((key, value, run, closed, before))
        if closed:
            run, total = run + 1, 0
        before = value if keep else before
    return out


@pytest.mark.parametrize("limit", [1, 7, 100])
@pytest.mark.parametrize("seed", [1, 2])
def test_runs_match_a_plain_fold_with_a_crowded_key(spark, limit, seed):
    rng = random.Random(seed)
    rows = []
    for at in range(3000):
        # One key has most of the rows, so whole partitions lie inside it.
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}"
        rows.append((key, f"{at:06d}", rng.choice([0, 1, 1, 2, 5, 30]), rng.random() < 0.6))
    df = spark.createDataFrame(rows, "key string, value string, weight int, keep boolean")
    df = df.repartition(7, F.rand(seed))
    got = number_runs(df, ["key"], ["value"], "weight", limit, "value", "keep", partitions=9)
    found = [tuple(r) for r in got.select("key", "value", "run_no", "run_closed", "previous").collect()]
    assert sorted(found, key=lambda r: r[:2]) == folded(rows, limit)


def test_runs_over_one_order_without_keys(spark):
    rows = [("", f"{at:04d}", at % 5, True) for at in range(500)]
    df = spark.createDataFrame(rows, "key string, value string, weight int, keep boolean")
    got = number_runs(df, [], ["value"], "weight", 11, "value", "keep", partitions=6)
    found = [tuple(r) for r in got.select("key", "value", "run_no", "run_closed", "previous").collect()]
    assert sorted(found, key=lambda r: r[1]) == folded(rows, 11)


def test_runs_of_nothing(spark):
    df = spark.createDataFrame([], "key string, value string, weight int, keep boolean")
    assert number_runs(df, ["key"], ["value"], "weight", 3, "value", "keep").count() == 0


def test_positions_over_partitions(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1009)
    got = numbered(df, [F.col("v").desc()], "at", partitions=5).collect()
    expected = {r.v: i + 1 for i, r in enumerate(sorted(got, key=lambda r: -r.v))}
    assert all(expected[r.v] == r.at for r in got)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, how):
    left = spark.range(600).select(
        F.when(F.col("id") < 300, 1).when(F.col("id") < 305, None).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    right = spark.range(90).select((F.col("id") % 45).alias("k"), F.col("id").alias("r")).where("k <> 7")
    plain = left.join(right, "k", how)
    assert rows(join_salted(left, right, ["k"], how, rows_per_key=100)) == rows(plain)


def test_attached_rows_equal_a_left_join(spark, rows):
    parents = spark.range(20).select(F.col("id").alias("k"), F.lit("p").alias("name"))
    owned = spark.range(200).select(
        F.when(F.col("id") < 150, 3).otherwise(F.col("id") % 30).alias("k"), F.col("id").alias("r")
    )
    assert rows(attach_rows(parents, owned, ["k"])) == rows(
        parents.join(owned, "k", "left").select("k", "name", "r")
    )
