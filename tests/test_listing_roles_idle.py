"""Files against what is declared, roles in roles, partitions a load leaves out, streams that stop and repeats."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quayside.operators import access
from quayside.operators import partitions as ops
from quayside.sources import listing
from quayside.streaming import arrivals, idle, permissions, refresh
from quayside.streaming.repeats import without_repeats
from test_sources_and_streams import events, registered


def test_listing_against_declared_files(spark, tmp_path):
    for name, text in [("a.txt", "1234"), ("b b.txt", "12"), ("zero.txt", ""), ("new.txt", "x"), ("_hidden", "x"), ("none.txt", "")]:
        for day in ("2020-01-01", "2020-01-02"):
            folder = tmp_path / "o" / f"trade-dt={day}"
            folder.mkdir(parents=True, exist_ok=True)
            if (name, day) != ("b b.txt", "2020-01-02"):
                (folder / name).write_text(text)
    listed = listing.scan_listing(spark, str(tmp_path / "o"), ["trade_dt"])
    assert listed.count() == 9
    assert {(r.file_name, r.file_size) for r in listed.collect()} == {("a.txt", 4), ("b b.txt", 2), ("zero.txt", 0), ("new.txt", 1), ("none.txt", 0)}
    # No content is read.
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    sizes = [("a.txt", 4), ("b b.txt", 3), ("zero.txt", 8), ("none.txt", 0)]
    declared = spark.createDataFrame(
        [(d, n, s) for d in ("2020-01-01", "2020-01-02") for n, s in sizes] + [("2020-01-03", "lost.txt", None), ("2020-01-01", "a.txt", None)],
        "trade_dt string, file_name string, file_size long")
    files = listing.file_differences(listed, declared, ["trade_dt", "file_name"])
    assert {(r.trade_dt[-2:], r.file_name): r.state for r in files.collect()} == {
        **{(d, n): s for d in ("01", "02") for n, s in [("a.txt", "same"), ("zero.txt", "empty"), ("none.txt", "same"), ("new.txt", "extra")]},
        ("01", "b b.txt"): "resized", ("02", "b b.txt"): "missing", ("03", "lost.txt"): "missing"}
    by_day = {r.trade_dt[-2:]: (r.same, r.resized, r.empty, r.missing, r.extra, r.whole) for r in listing.partition_differences(files, ["trade_dt"]).collect()}
    assert by_day == {"01": (2, 1, 1, 0, 1, False), "02": (2, 0, 1, 1, 1, False), "03": (0, 0, 0, 1, 0, False)}


def test_roles_in_roles(spark):
    """Chains, a cycle, a role in two others, and members that are no role."""
    roles = spark.createDataFrame([(k, f"r{k}") for k in range(8)], "role_id long, role_name string")
    links = [(0, "r1"), (1, "r2"), (2, "r3"), (4, "r5"), (5, "r4"), (5, "r3"), (6, "gone"), (7, "r7")]
    users = [(k, f"u{k}") for k in range(8)] + [(0, "u3")]
    role_map = spark.createDataFrame([(k, n, "ROLE") for k, n in links] + [(k, n, "USER") for k, n in users],
                                     "role_id long, principal_name string, principal_type string")
    below = {0: {1, 2, 3}, 1: {2, 3}, 2: {3}, 3: set(), 4: {3, 4, 5}, 5: {3, 4, 5}, 6: set(), 7: {7}}
    found = sorted((r.role_name, r.member_role) for r in access.nested_roles(roles, role_map).collect())
    assert found == sorted((f"r{k}", f"r{m}") for k, ms in below.items() for m in ms)
    members = sorted((r.role_name, r.user) for r in access.all_role_members(roles, role_map).collect())
    assert members == sorted({(f"r{k}", u) for k, ms in below.items() for j, u in users if j == k or j in ms})
    grants = spark.createDataFrame([("ROLE", "r0", "d", "t", "SELECT")], "principal_type string, principal string, db_name string, tbl_name string, privilege string")
    asked = spark.createDataFrame([(f"u{k}", "d", "t") for k in range(8)], "user string, db_name string, tbl_name string")
    allowed = {r.user for r in access.decisions(asked, grants, access.all_role_members(roles, role_map)).collect() if r.allowed}
    assert allowed == {"u0", "u1", "u2", "u3"}
    assert access.nested_roles(roles, role_map.limit(0)).count() == 0


def test_partitions_nobody_has(spark):
    key = ("N", "O", "U", "T")
    names = "namespace string, object_name string, usage_code string, file_type string"
    items = spark.createDataFrame(
        [(1, *key, 0, "d", "2020-01-02__2020-01-01"), (2, *key, 0, "d", "2020-01-01:x"), (3, *key, 0, "d", "2020-01-01:y"), (4, *key, 1, "d", "2020-01-09"),
         (5, *key, 1, "partition", "none")], f"id long, {names}, wf_type int, partition_key string, partition_values string")
    data = spark.createDataFrame([(*key, "2020-01-01", ["x", "k"], "p")], f"{names}, partition_value string, sub_partition_values array<string>, file_path string")
    assert sorted(tuple(r) for r in ops.unavailable_partitions(items, data).collect()) == [
        (1, "values", "2020-01-02"), (3, "sub-partitions", "2020-01-01:y"), (5, "none", "none")]


def refreshing(spark, tmp_path, source):
    stream = spark.readStream.schema("id long").parquet(source)
    return lambda trigger: refresh.start_refresh(
        stream, lambda number: spark.range(number + 1), str(tmp_path / "out"), str(tmp_path / "cp"), **trigger)


def test_a_stream_stops_when_idle_and_starts_at_work(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    start = refreshing(spark, tmp_path, source)
    began = time.monotonic()
    assert idle.run_until_idle(spark, start, 0.5, 4) == 1
    assert time.monotonic() - began >= 2 and not spark.streams.active
    # Nothing runs while there is no work; then the query goes on behind what it has read.
    answers, waited = iter([False, False, True, False, True]), []

    def has_work():
        found = next(answers)
        if found:
            spark.range(7).write.mode("append").parquet(source)
        return found

    assert idle.run_while_work_comes(spark, start, has_work, 0.5, 3, rounds=2, wait=waited.append) == 2
    assert len(waited) == 3 and not spark.streams.active
    batches = sorted(r.batch for r in spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().collect())
    assert batches == [0, 1, 2]


def test_an_error_of_the_query_is_raised(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(2).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)

    def broken(number):
        raise ValueError("no pending work table")

    with pytest.raises(Exception, match="no pending work table"):
        idle.run_until_idle(spark, lambda t: refresh.start_refresh(stream, broken, str(tmp_path / "o"), str(tmp_path / "c"), **t), 0.5, 4)


def test_events_delivered_again(spark, tmp_path, rows):
    """Repeats inside a batch, in later batches and after a restart give one set of items."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    told = events(spark).withColumn("event_time", F.timestamp_seconds(1_600_000_000 + F.col("event_id")))

    def deliver(*ids):
        told.where(F.col("event_id").isin(*ids)).unionByName(told.where(F.col("event_id") == ids[0])).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", 1).parquet(source)
        arrivals.start_arrivals(stream, lambda: registered(spark), sink, str(tmp_path / "cp"), repeats_within="1 hour").awaitTermination()
        return rows(spark.read.parquet(sink).drop("batch"))

    deliver(1, 2)
    deliver(2, 3, 1)
    run()
    deliver(4, 1, 2)
    assert run() == rows(arrivals.work_items(events(spark), registered(spark)))
    assert without_repeats(told.unionByName(told), ["event_id"], "event_time", "1 hour").count() == 4


def test_permission_messages_delivered_again(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    body = '{"action":"delta_sync","userId":"ann","namespace":"NS"}'
    for at, key in enumerate(("m1", "m2", "m1")):
        spark.createDataFrame([(key, body)], "message_id string, value string").withColumn(
            "event_time", F.timestamp_seconds(F.lit(1_600_000_000 + at))).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("message_id string, value string, event_time timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    permission = spark.createDataFrame([("NS", "ann", ["READ"])], "namespace string, user_id string, permissions array<string>")
    names = spark.createDataFrame([("ns", "t")], "db_name string, tbl_name string")
    held = spark.createDataFrame([], "principal_type string, principal string, db_name string, tbl_name string, privilege string")
    permissions.start_permission_sync(stream, lambda: permission, lambda: names, lambda: held, sink, str(tmp_path / "cp"), repeats_within="1 hour").awaitTermination()
    # Two messages are answered; the third batch has nothing to answer.
    assert spark.read.parquet(sink).groupBy("batch").count().count() == 2
