"""Rows deleted at the grain of files."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.partitions import quoted
from quayside.sources import deletes, sinks

SCHEMA = T.StructType().add("id", "long").add("kind", "string")


@pytest.fixture
def table(spark, tmp_path):
    made = []

    def make(name, *args, **options):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        sinks.create_table(spark, name, SCHEMA, str(tmp_path / name), *args, **options)
        made.append(name)
        return tmp_path / name

    yield make
    for name in made:
        sinks.drop_object(spark, name)


def data_files(root):
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in Path(root).rglob("part-*") if not f.name.endswith(".crc")}


def ids(spark, name):
    return [r.id for r in spark.table(name).orderBy("id").collect()]


def test_only_touched_files_are_written_anew(spark, table):
    root = table("many_files")
    for k in range(5):
        spark.range(10 * k, 10 * k + 10, 1, 1).select("id", F.lit("x").alias("kind")).write.insertInto("many_files")
    before = data_files(root)
    assert len(before) == 5
    done = deletes.delete_rows(spark, "many_files", F.col("id").isin(23, 24))
    assert done == deletes.Deleted(rows=2, files=1, written=1, partitions=0)
    after = data_files(root)
    # Four files as they were, one in the place of the fifth.
    assert len(after) == 5 and len(set(before.items()) & set(after.items())) == 4
    assert ids(spark, "many_files") == [i for i in range(50) if i not in (23, 24)]
    assert deletes.delete_rows(spark, "many_files", F.col("id") > 1000) == deletes.Deleted(0, 0, 0, 0)
    assert deletes.delete_rows(spark, "many_files", F.col("id") < 10) == deletes.Deleted(10, 1, 0, 0)
    assert len(data_files(root)) == 4 and data_files(root).items() <= after.items()
    deletes.delete_rows(spark, "many_files", F.lit(True))
    assert ids(spark, "many_files") == [] and not list(root.glob("_rows-*"))


def test_partitions_with_odd_values(spark, table):
    root = table("odd_parts", partition_columns=["kind"])
    values = ["O'Brien", "a b", "x=1/2", "50%", None, "back\\slash", "plain"]
    rows = [(10 * k + n, v) for k, v in enumerate(values) for n in range(4)]
    spark.createDataFrame(rows, SCHEMA).repartition(1).write.insertInto("odd_parts")
    before = data_files(root)
    gone = (F.col("id") % 10 == 1) & F.coalesce(F.col("kind") != "plain", F.lit(True)) | (F.col("kind") == "a b") | ((F.col("id") < 4) & (F.col("kind") == "O'Brien"))
    done = deletes.delete_rows(spark, "odd_parts", gone)
    left = [(i, v) for i, v in rows if not ((i % 10 == 1 and v != "plain") or v == "a b" or v == "O'Brien")]
    assert done == deletes.Deleted(rows=len(rows) - len(left), files=6, written=4, partitions=2)
    assert sorted(((r.id, r.kind) for r in spark.table("odd_parts").collect())) == left
    assert [k for k in data_files(root) if "kind=plain" in k] == [k for k in before if "kind=plain" in k]
    assert spark.sql("SHOW PARTITIONS odd_parts").count() == 5
    # A null partition can be emptied too, and rows come back to a dropped one.
    deletes.delete_rows(spark, "odd_parts", F.col("kind").isNull())
    assert spark.sql("SHOW PARTITIONS odd_parts").count() == 4
    spark.createDataFrame([(7, "O'Brien")], SCHEMA).write.insertInto("odd_parts")
    assert [r.id for r in spark.table("odd_parts").where("kind = \"O'Brien\"").collect()] == [7]


def test_text_with_its_own_separator(spark, table):
    table("cut_text", "csv", sep="|")
    spark.range(0, 6, 1, 2).select("id", F.lit("x,y").alias("kind")).write.insertInto("cut_text")
    deletes.delete_rows(spark, "cut_text", F.col("id") == 0)
    deletes.delete_rows(spark, "cut_text", F.col("id") == 4)
    assert [tuple(r) for r in spark.table("cut_text").orderBy("id").collect()] == [(i, "x,y") for i in (1, 2, 3, 5)]
    # An unknown truth deletes nothing.
    assert deletes.delete_rows(spark, "cut_text", F.lit(None).cast("boolean")).rows == 0


@pytest.mark.parametrize("step", ["write", "move", "remove"])
def test_a_delete_that_was_cut_off(spark, table, monkeypatch, step):
    """In front of its journal nothing has changed; behind it the next call finishes."""
    root = table("cut_off", partition_columns=["kind"])
    for k in range(3):
        spark.createDataFrame([(k, "a"), (k + 3, "a"), (10 + k, "b"), (13 + k, "b")], SCHEMA).repartition(1).write.insertInto("cut_off")
    calls, inner = [], getattr(deletes._Files, step)

    def failing(self, *args):
        calls.append(args)
        if len(calls) == (1 if step == "write" else 2):
            raise RuntimeError("cut off")
        return inner(self, *args)

    monkeypatch.setattr(deletes._Files, step, failing)
    with pytest.raises(RuntimeError, match="cut off"):
        deletes.delete_rows(spark, "cut_off", F.col("id").isin(0, 11))
    monkeypatch.undo()
    spark.catalog.refreshTable("cut_off")
    if step == "write":
        assert ids(spark, "cut_off") == [*range(6), *range(10, 16)]
        assert deletes.finish_deletes(spark, "cut_off") == 0
    else:
        journal = json.loads(next(root.glob("_rows-*")).joinpath("_journal.json").read_text())
        assert journal["gone"]
        assert deletes.finish_deletes(spark, "cut_off") == 1
        assert ids(spark, "cut_off") == [*range(1, 6), 10, *range(12, 16)]
    assert not list(root.glob("_rows-*"))


def test_literals_of_statements(spark):
    texts = ["O'Brien", "back\\slash", "a\\'b", "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, literal in df.select("t", quoted(F.col("t"))).collect():
        assert spark.sql(f"SELECT {literal}").first()[0] == text


def test_partitions_are_pointed_to_odd_places(spark, table, tmp_path):
    table("pointed", partition_columns=["kind"])
    place = str(tmp_path / "it's here")
    spark.range(3).write.parquet(place)
    parts = spark.createDataFrame([("O'Brien", place)], "v string, location string").select(
        F.concat(F.lit("kind="), quoted(F.col("v"))).alias("spec"), "location")
    assert sinks.add_partitions(spark, "pointed", parts) == 1
    assert spark.table("pointed").where("kind = \"O'Brien\"").count() == 3
    sinks.replace_partitions(spark, "pointed", "kind", parts)
    assert ids(spark, "pointed") == [0, 1, 2]
