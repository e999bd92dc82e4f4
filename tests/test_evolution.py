from __future__ import annotations

from pyspark.sql import types as T

from quayside.operators import evolution
from quayside.operators.profile import column_profile, reconciled

COLUMNS = "table_name string, is_partition boolean, ordinal int, name string, type string"
TABLES = "table_name string, namespace string, format_version int, file_type string, wf_type int, partition_key string"


def schema(spark, columns, partitions=(("dt", "date"),), table="t"):
    rows = [(table, False, i, n, t) for i, (n, t) in enumerate(columns)]
    rows += [(table, True, i, n, t) for i, (n, t) in enumerate(partitions)]
    return spark.createDataFrame(rows, COLUMNS)


def tables(spark, file_type="ORC", wf_type=0, key="dt"):
    return spark.createDataFrame([("t", "ns", 3, file_type, wf_type, key)], TABLES)


OLD = [("id", "bigint"), ("price", "decimal(18,0)"), ("code", "varchar(4)")]


def plan(spark, new, **options):
    old = schema(spark, OLD)
    changes = evolution.column_changes(old, schema(spark, new))
    made = evolution.change_plan(tables(spark, **options), changes, schema(spark, new))
    return [r.statement for r in made.orderBy("step", "ordinal").collect()]


def test_other_spellings_are_no_change(spark):
    new = [("ID", "BIGINT"), ("Price", "DECIMAL(18)"), ("CODE", "VARCHAR(4)")]
    assert plan(spark, new) == [] and plan(spark, new, file_type="TXT") == []


def test_columnar_tables_change_column_by_column(spark):
    new = [("id", "string"), ("price", "decimal(18,0)"), ("mark", "varchar(6)"), ("a", "int"), ("b", "date")]
    assert plan(spark, new) == [
        "Alter table t change code mark varchar(6) CASCADE;",
        "Alter table t change id id string CASCADE;",
        "Alter table t add columns (a int,b date) CASCADE;",
    ]


def test_one_retyped_and_two_added_give_two_statements(spark):
    new = [*OLD[:2], ("code", "varchar(6)"), ("a", "int"), ("b", "int")]
    made = plan(spark, new)
    assert len(made) == 2 and all(s.endswith("CASCADE;") for s in made)


def test_text_tables_replace_all_columns(spark):
    assert plan(spark, [*OLD, ("a", "int")], file_type="TXT") == [
        "ALTER TABLE `t` REPLACE COLUMNS (`id` bigint, `price` decimal(18,0), `code` varchar(4), `a` int) CASCADE;"
    ]


def test_unpartitioned_singletons_are_always_replaced(spark):
    made = plan(spark, OLD, wf_type=1, key="Partition")
    assert made == ["ALTER TABLE `t` REPLACE COLUMNS (`id` bigint, `price` decimal(18,0), `code` varchar(4));"]


def test_a_rename_hides_a_retype_and_dropped_columns_are_silent(spark):
    old, new = schema(spark, OLD), schema(spark, [("key", "string"), ("price", "decimal(18,0)")])
    assert [r.change for r in evolution.column_changes(old, new).collect()] == ["name"]
    reported = evolution.column_changes(old, new, report_dropped=True)
    assert sorted(r.change for r in reported.collect()) == ["dropped", "name"]


def test_partition_changes(spark):
    def changed(new):
        flags = evolution.partition_changes(schema(spark, OLD), schema(spark, OLD, new))
        return flags.first().partition_changed

    assert not changed([("DT", "DATE")])
    assert changed([("dt", "string")]) and changed([("day", "date")])
    assert changed([("dt", "date"), ("region", "string")])


def test_flags_and_report(spark):
    old = schema(spark, OLD)
    new = schema(spark, [("key", "bigint"), ("price", "int"), OLD[2], ("a", "int")], [("dt", "date"), ("r", "string")])
    changes, moved = evolution.column_changes(old, new), evolution.partition_changes(old, new)
    flags = evolution.change_flags(tables(spark), changes, moved).first()
    assert (flags.column_changed, flags.partition_changed, flags.changed) == (True, True, True)
    report = evolution.change_reports(tables(spark), changes, old, new, moved).first().report
    assert report.splitlines() == [
        "Namespace: ns  Table Name: t   Format Version from Data Management: 3", "",
        "Column Name Changes:", "  From 0 -> id(bigint) to 0 -> key(bigint)", "",
        "Column Type Changes:", "    1 price: From decimal(18,0) to int", "",
        "New Columns:", "    3 -> a(int)", "",
        "Partition Column Change:", "\tExisting Partition Column(s):", "\t\t0 -> dt(date)",
        "\tNew Partition Column(s):", "\t\t0 -> dt(date)", "\t\t1 -> r(string)",
    ]


def test_format_changes_are_off_by_default(spark):
    marks = "table_name string, delimiter string, escape string, null_token string"
    old = spark.createDataFrame([("t", "\\u0002", "\\", "x")], marks)
    new = spark.createDataFrame([("t", "\\002", "|", "y")], marks)
    assert tuple(evolution.format_changes(old, new).first())[1:] == (False, False, False)
    assert tuple(evolution.format_changes(old, new, detect=True).first())[1:] == (False, True, True)


def test_columns_by_position(spark):
    df = spark.createDataFrame([(1, "2", "x")], "a int, b string, c string")
    wanted = T.StructType().add("k", "long").add("n", "integer").add("c", "string").add("d", "date")
    assert tuple(evolution.under_schema(df, wanted).first()) == (1, 2, "x", None)
    shorter = T.StructType().add("k", "long")
    assert tuple(evolution.under_schema(df, shorter).first()) == (1,)


def test_profile_of_an_empty_and_a_null_column(spark):
    df = spark.createDataFrame([(1, None, True), (2, None, None)], "a int, b string, c boolean")
    found = {r.column_name: r for r in column_profile(df, ["a", "b", "c"], exact=True).collect()}
    assert (found["a"].low, found["a"].high, found["a"].distincts) == ("1", "2", 2)
    assert (found["b"].nulls, found["b"].distincts, found["b"].avg_length) == (2, 0, None)
    assert (found["c"].trues, found["c"].falses, found["c"].nulls) == (1, 0, 1)
    estimated = {r.column_name: r.distincts for r in column_profile(df, ["a", "b"]).collect()}
    assert estimated == {"a": 2, "b": 0}


def test_reconciliation_reports_every_difference(spark):
    counted = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "f string, row_count long")
    declared = spark.createDataFrame([("a", 2), ("b", 2), ("d", 5)], "f string, row_count long")
    assert {r.f: r.state for r in reconciled(counted, declared, ["f"]).collect()} == {
        "a": "mismatch", "b": "match", "c": "undeclared", "d": "missing",
    }
