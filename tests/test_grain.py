"""What one task holds, and what is computed once."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

from __spark_entry__ import queries
from quayside.operators import partitions as ops
from quayside.operators.asof import as_of_join
from quayside.session import GRAIN, stable, tune_tables, tune_texts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def fine(spark):
    """Table settings with pieces of a few kilobytes instead of megabytes."""
    tune_tables(spark)
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for name in names:
        spark.conf.set(name, "8k")
    yield spark
    for name in names:
        spark.conf.unset(name)
    tune_texts(tune_tables(spark))


def test_exchanges_are_cut_by_size(fine):
    rows = fine.range(200_000, numPartitions=4).selectExpr("id", "cast(id as string) as text")
    assert len(stable(rows.groupBy("text").count()).inputFiles()) > int(fine.conf.get("spark.sql.shuffle.partitions"))


def test_ranges_of_as_of_lookups_are_cut_by_size(fine):
    rows = fine.range(20_000).selectExpr("id", "id % 3 as k", "id as t")
    entries = fine.range(5_000).selectExpr("id % 3 as k", "id * 4 as u", "id as value")
    found = as_of_join(rows, entries, ["k"], rows["t"], entries["u"], ["value"])
    wanted = {r.id: max((v for v in range(max(0, r.t // 4 - 3), r.t // 4 + 1) if v < 5000 and v % 3 == r.k), default=None)
              for r in rows.where("id < 300").collect()}
    assert {r.id: r.value for r in found.where("id < 300").collect()} == wanted
    parts = [f for f in found.inputFiles()]
    assert len(parts) > int(fine.conf.get("spark.sql.shuffle.partitions"))


def test_texts_keep_their_own_settings(spark):
    tune_texts(tune_tables(spark))
    assert all(spark.conf.get(k, None) != v for k, v in GRAIN.items())


def test_deliveries_are_not_gathered_in_one_task(spark, monkeypatch):
    def gathered(self, count):
        raise AssertionError("all deliveries in one task")

    monkeypatch.setattr(DataFrame, "coalesce", gathered)
    monkeypatch.setattr(type(spark.range(1)), "coalesce", gathered)
    once, twice = (queries()[f"stm1_work_items_{name}"](spark, SMALL).count() for name in ("from_events", "without_repeats"))
    assert once == twice > 0
    tune_texts(spark)


def test_requested_partitions_are_computed_once(spark):
    shape = ["'t' as table_name", "cast(id as string) as partition_value", "concat('k=', id) as part_name", "concat('s3://', id) as location"]
    existing = spark.createDataFrame([("t", "1999-01-01", "k=9", "s3://9")], "table_name string, partition_value string, part_name string, location string")
    fresh = spark.range(3).selectExpr(*shape)
    for found in (ops.added_partitions(existing, fresh), ops.refreshed_singletons(existing, fresh)):
        assert "Range" not in found._jdf.queryExecution().toString()
        assert {r.part_name for r in found.collect()} >= {"k=0", "k=1", "k=2"}
