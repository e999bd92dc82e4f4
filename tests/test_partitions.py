from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from quayside.operators import partitions as ops

DATA = (
    "namespace string, object_name string, usage_code string, file_type string, partition_value string, "
    "sub_partition_values array<string>, format_version int, data_version int, status string, file_path string"
)
KEY = ("N", "O", "U", "T")
ITEMS = "execution_id string, partition_values string"


def data(spark, *rows):
    full = [(*KEY, v, s, fv, dv, st, f"{v}/{s}/{fv}/{dv}") for v, s, fv, dv, st in rows]
    return spark.createDataFrame(full, DATA)


def plan(spark, parts, is_date, submitted=(), chunk=100, **options):
    requests = spark.createDataFrame(
        [(*KEY, 7, "k", "corr", "cl")],
        "namespace string, object_name string, usage_code string, file_type string, id int, "
        "partition_key string, correlation_data string, cluster_name string",
    )
    keyed = spark.createDataFrame(
        [(*KEY, is_date)],
        "namespace string, object_name string, usage_code string, file_type string, is_date boolean",
    )
    items = spark.createDataFrame(list(submitted), ITEMS)
    made = ops.back_load_plan(requests, parts, items, keyed, chunk, **options)
    return [(r.chunk_no, r.partition_values) for r in made.orderBy("chunk_no").collect()]


def days(n, start=date(2016, 1, 1)):
    return [(start + timedelta(days=i)).isoformat() for i in range(n)]


def test_latest_valid_versions(spark):
    found = ops.latest_valid(
        data(
            spark,
            ("a", None, 1, 9, "VALID"), ("a", None, 2, 0, "VALID"), ("a", None, 3, 0, "INVALID"),
            ("b", ["x"], 1, 0, "VALID"), ("b", ["y"], 1, 0, "VALID"), ("b", ["y"], 1, 1, "VALID"),
        )
    )
    assert sorted((r.partition_value, r.format_version, r.data_version) for r in found.collect()) == [
        ("a", 2, 0), ("b", 1, 0), ("b", 1, 1),
    ]


def test_latest_before_includes_tomorrow(spark):
    parts = data(spark, *[(v, None, 1, 0, "VALID") for v in ("2020-01-01", "2020-01-03", "2020-01-04")])
    found = ops.latest_before(parts, F.lit("2020-01-02").cast("date"))
    assert found.first().partition_value == "2020-01-03"


def test_three_dates_with_fifty_sub_partitions(spark):
    parts = data(spark, *[(d, [str(s)], 1, 0, "VALID") for d in days(3) for s in range(50)])
    assert plan(spark, parts, True) == [
        (0, "2016-01-02__2016-01-01"), (1, "2016-01-03__2016-01-02"),
    ]


def test_many_dates_without_sub_partitions(spark):
    values = sorted(days(179) + ["2016-02-30"])
    parts = data(spark, *[(d, None, 1, 0, "VALID") for d in values])
    assert plan(spark, parts, True) == [
        (0, f"{values[99]}__{values[0]}"), (1, f"{values[179]}__{values[99]}"),
    ]


def test_two_thousand_values_in_string_order(spark):
    parts = data(spark, *[(str(v), None, 1, 0, "VALID") for v in range(2000)])
    made = plan(spark, parts, False)
    ordered = sorted(str(v) for v in range(2000))
    assert len(made) == 20
    for at, (chunk, listed) in enumerate(made):
        assert chunk == at
        assert listed.split(",") == ordered[100 * at : 100 * at + 100][::-1]


def test_submitted_values_are_left_out(spark):
    parts = data(spark, *[(d, None, 1, 0, "VALID") for d in days(8)])
    d = days(8)
    done = [("7", f"{d[3]}__{d[0]}"), ("7", f"{d[6]},{d[7]}"), ("7", d[4]), ("8", f"{d[1]},{d[2]}")]
    # Ends of ranges and items of lists count, the inside of a range does not.
    assert plan(spark, parts, True, done, chunk=4) == [
        (0, f"{d[2]}__{d[1]}"), (1, f"{d[5]}__{d[2]}"),
    ]
    assert plan(spark, parts, True, done, chunk=4, strict=True) == [(1, f"{d[5]}__{d[5]}")]


def test_a_chunk_submitted_whole_is_skipped_between_two(spark):
    d = days(6)
    parts = data(spark, *[(v, None, 1, 0, "VALID") for v in d])
    assert plan(spark, parts, True, [("7", f"{d[2]},{d[3]}")], chunk=2) == [
        (0, f"{d[1]}__{d[0]}"), (2, f"{d[5]}__{d[1]}"),
    ]


def test_nothing_to_load_is_reported(spark):
    assert plan(spark, data(spark, ("a", None, 1, 0, "INVALID")), True) == [(None, None)]


def test_partition_table_changes(spark, rows):
    schema = "table_name string, part_name string, location string"
    existing = spark.createDataFrame([("t", "d=1", "old"), ("t", "d=2", "keep")], schema)
    wanted = spark.createDataFrame([("t", "d=1", "new"), ("t", "d=3", "x"), ("t", "d=3", "x")], schema)
    once = ops.added_partitions(existing, wanted)
    assert rows(once) == [("t", "d=1", "new"), ("t", "d=2", "keep"), ("t", "d=3", "x")]
    assert rows(ops.added_partitions(once, wanted)) == rows(once)
    diff = ops.partition_diff(wanted.distinct(), existing)
    assert sorted((r.part_name, r.change) for r in diff.collect()) == [
        ("d=1", "move"), ("d=2", "unregistered"), ("d=3", "add"),
    ]


def test_singletons_drop_dated_partitions(spark, rows):
    schema = "table_name string, partition_value string, part_name string, location string"
    existing = spark.createDataFrame(
        [("t", "2020-01-01", "d=2020-01-01", "a"), ("t", "1970-01-01", "d=1970-01-01", "b"), ("u", "2020-01-01", "d=2020-01-01", "c")],
        schema,
    )
    latest = spark.createDataFrame([("t", "2020-01-02", "d=2020-01-02", "n")], schema)
    assert [r[:2] for r in rows(ops.refreshed_singletons(existing, latest))] == [
        ("t", "1970-01-01"), ("t", "2020-01-02"), ("u", "2020-01-01"),
    ]


def test_partial_specs_find_partitions(spark):
    parts = spark.createDataFrame(
        [("t", "a=1/b=1"), ("t", "a=1/b=2"), ("t", "a=11/b=1"), ("u", "a=1/b=1")], "table_name string, part_name string"
    )
    specs = spark.createDataFrame([("t", "a=1"), ("u", "a=1/b=1")], "table_name string, spec string")
    found = ops.existing_partitions(parts, specs).collect()
    assert sorted(tuple(r) for r in found) == [("t", "a=1/b=1"), ("t", "a=1/b=2"), ("u", "a=1/b=1")]
    assert ops.existing_partitions(parts).count() == 4


def test_selection_by_fewer_levels_takes_everything_below(spark):
    base = data(
        spark, ("d", ["r1", "k1"], 1, 0, "VALID"), ("d", ["r1", "k2"], 1, 0, "VALID"), ("d", ["r2", "k1"], 1, 0, "VALID")
    )
    items = spark.createDataFrame(
        [(1, *KEY, 0, "d,r,k", "d:r1"), (2, *KEY, 0, "d,r,k", "d:r1:k2"), (3, *KEY, 0, "d", "d")],
        "id int, namespace string, object_name string, usage_code string, file_type string, wf_type int, "
        "partition_key string, partition_values string",
    )
    found = ops.selected_partitions(items, base, F.lit("2020-01-01").cast("date")).groupBy("id").count()
    assert {r.id: r["count"] for r in found.collect()} == {1: 2, 2: 1, 3: 3}
