from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quayside.operators import leases as lease_ops
from quayside.operators import work
from quayside.plans.round import close_round

NOW = datetime(2020, 5, 1, 12, 0, 0)
ITEM = (
    "id int, namespace string, object_name string, usage_code string, file_type string, "
    "date_created timestamp, partition_key string, partition_values string, wf_type int, "
    "correlation_data string, execution_id string, cluster_name string"
)
LOG = "id int, notification_id int, date_processed timestamp, end_time timestamp, success string, cluster_id string"
LEASE = (
    "namespace string, object_name string, usage_code string, file_type string, cluster_id string, "
    "worker_id string, wf_type int, expiration_dt timestamp"
)
REQUEST = (
    "seq int, namespace string, object_name string, usage_code string, file_type string, wf_type int, "
    "cluster_id string, worker_id string"
)


def item(id, name="A", values="2020-01-01", wf=0, created=NOW, correlation=None):
    return (id, "A", name, "A", "A", created, "tdate", values, wf, correlation, f"e{id}", "c")


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def leases(spark, *rows):
    return spark.createDataFrame(list(rows), LEASE)


def workflows(spark, *rows):
    return spark.createDataFrame(list(rows or [(0, 10, "x"), (1, 5, "y")]), "workflow_id int, priority int, workflow_name string")


def granted(spark, held, *requests):
    decided = lease_ops.request_decisions(held, spark.createDataFrame(list(requests), REQUEST), NOW)
    return {r.seq: r.granted for r in decided.collect()}


def after(spark, held, *requests):
    return lease_ops.merged_leases(held, spark.createDataFrame(list(requests), REQUEST), NOW)


def test_lease_sequence(spark):
    none = leases(spark)
    first = (1, "A", "B", "C", "D", 0, "C111", "T1")
    assert granted(spark, none, first) == {1: True}
    held = after(spark, none, first)
    assert granted(spark, held, first) == {1: True}
    other = (2, "A", "B", "C", "D", 0, "C222", "T2")
    assert granted(spark, held, other) == {2: False}
    moved = (3, "A2", "B2", "C2", "D2", 0, "C111", "T1")
    assert granted(spark, held, moved) == {3: True}
    held = after(spark, held, moved)
    assert [r.namespace for r in held.collect()] == ["A2"]
    colleague = (4, "A2", "B2", "C2", "D2", 0, "C111", "T2")
    assert granted(spark, held, colleague) == {4: False}


def test_lease_of_a_late_reporting_object(spark):
    held = leases(spark, ("A", "ABC", "A", "A", "C1", "T1", 0, NOW + timedelta(minutes=3)))
    late = item(1, "ABC_LATE", correlation='{"businessObject":{"late_reporting_for":"ABC"}}')
    decoded = work.decoded_items(items(spark, late).withColumn("attempts", F.lit(0))).first()
    asked = (1, "A", decoded.actual_object_name, "A", "A", 0, "C2", "T1")
    assert granted(spark, held, asked) == {1: False}


def test_the_earliest_request_wins_and_an_own_lease_is_extended(spark):
    held = leases(spark, ("A", "X", "A", "A", "C1", "T1", 0, NOW + timedelta(minutes=1)))
    requests = [
        (1, "A", "X", "A", "A", 0, "C1", "T1"),
        (2, "A", "Y", "A", "A", 0, "C2", "T1"),
        (3, "A", "Y", "A", "A", 0, "C3", "T1"),
    ]
    assert granted(spark, held, *requests) == {1: True, 2: True, 3: False}
    result = {(r.object_name, r.cluster_id): r.expiration_dt for r in after(spark, held, *requests).collect()}
    assert result == {("X", "C1"): NOW + timedelta(minutes=5), ("Y", "C2"): NOW + timedelta(minutes=5)}


def test_expired_leases_go(spark):
    held = leases(
        spark,
        ("A", "1", "A", "A", "C", "T1", 0, NOW + timedelta(minutes=1)),
        ("A", "2", "A", "A", "C", "T2", 0, NOW + timedelta(minutes=2)),
        ("A", "3", "A", "A", "C", "T3", 0, datetime(2016, 1, 1)),
    )
    live, expired = lease_ops.split_expired(held, NOW)
    assert live.count() == 2 and expired.first().object_name == "3"


def eligible(spark, rows, attempts=(), held=(), cluster="C03", retry=120, **options):
    return work.eligible_work(
        items(spark, *rows), log(spark, *attempts), workflows(spark), leases(spark, *held),
        as_of=NOW, max_attempts=3, retry_seconds=retry, cluster_id=cluster, **options,
    )


def test_retry_back_off(spark):
    past = [NOW - timedelta(seconds=600), NOW - timedelta(seconds=60)]
    attempts = [(1, 7, past[0], None, "N", "c"), (2, 7, past[1], None, "N", "c")]
    assert eligible(spark, [item(7)], attempts, retry=30).count() == 1
    assert eligible(spark, [item(7)], attempts, retry=80).count() == 0
    spent = attempts + [(3, 7, past[1], None, "N", "c")]
    assert eligible(spark, [item(7)], spent, retry=30).count() == 0


def test_a_success_ends_and_an_open_attempt_may_be_tried_again(spark):
    past = NOW - timedelta(seconds=600)
    rows = [item(1), item(2)]
    attempts = [(1, 1, past, None, "N", "c"), (2, 1, past, None, "Y", "c"), (3, 2, past, None, "P", "c")]
    assert [r.id for r in eligible(spark, rows, attempts).collect()] == [2]
    # The backlog counts failures only.
    assert work.backlog(items(spark, *rows), log(spark, *attempts), max_attempts=3).count() == 0


def test_leases_of_others_hide_an_object(spark):
    live = NOW + timedelta(minutes=3)
    rows = [item(1, "X"), item(2, "Y"), item(3, "Z", correlation='{"businessObject":{"late_reporting_for":"Y"}}')]
    held = [("A", "X", "A", "A", "C03", "T", 0, live), ("A", "Y", "A", "A", "C02", "T", 0, live)]
    assert sorted(r.id for r in eligible(spark, rows, held=held).collect()) == [1, 3]
    assert sorted(r.id for r in eligible(spark, rows, held=held, match_on="actual").collect()) == [1]
    stats_lease = [("A", "Y", "A", "A", "C02", "T", 5, live)]
    assert eligible(spark, rows, held=stats_lease).count() == 3


def test_next_batch_is_the_first_run_of_one_object(spark):
    live = NOW + timedelta(minutes=3)
    rows = [
        item(1, "B", "2020-01-09"), item(2, "A", "2020-01-08"), item(3, "A", "2020-01-07"),
        item(4, "C", "2020-01-06"), item(5, "A", "2020-01-05"),
    ]
    held = [("A", "B", "A", "A", "C02", "T", 0, live)]
    todo = eligible(spark, rows, held=held)
    batch = work.next_batch(todo, leases(spark, *held), cluster_id="C03", worker_id="T1", as_of=NOW)
    assert sorted(r.id for r in batch.collect()) == [2, 3]


def test_next_batch_skips_what_a_colleague_holds(spark):
    live = NOW + timedelta(minutes=3)
    rows = [item(1, "B", "2020-01-09"), item(2, "A", "2020-01-08"), item(3, "B", "2020-01-07"), item(4, "A", "2020-01-06")]
    held = [("A", "B", "A", "A", "C03", "T9", 0, live)]
    todo = eligible(spark, rows, held=held)
    assert todo.count() == 4
    batch = work.next_batch(todo, leases(spark, *held), cluster_id="C03", worker_id="T1", as_of=NOW)
    assert [r.id for r in batch.collect()] == [2]
    none = work.next_batch(
        eligible(spark, rows[:1], held=held), leases(spark, *held), cluster_id="C03", worker_id="T1", as_of=NOW
    )
    assert none.count() == 0


def test_next_batch_with_unknown_priorities_and_ties(spark):
    rows = [item(1, "A", "v", wf=8), item(2, "A", "v", wf=8), item(3, "A", "w", wf=0), item(4, "A", None, wf=8)]
    todo = eligible(spark, rows)
    batch = work.next_batch(todo, leases(spark), cluster_id="C03", worker_id="T1", as_of=NOW)
    assert sorted(r.id for r in batch.collect()) == [1, 2, 4]
    assert [r.id for r in work.in_work_order(todo).collect()] == [1, 2, 4, 3]


def sizing(spark, rows, max_units=10, single=25, total=25, hours=3):
    groups = work.backlog_by_object(work.backlog(items(spark, *rows), log(spark), max_attempts=3))
    judged = work.classified_backlog(
        groups, as_of=NOW, single_threshold=single, total_threshold=total, age_hours=hours
    )
    return work.backlog_sizing(judged, max_units).first().units


def test_sizing(spark):
    rows = [item(1, "A", created=datetime(2016, 1, 1)), item(2, "A"), item(3, "B")]
    assert sizing(spark, rows) == 2
    assert sizing(spark, rows, max_units=1) == 1
    assert sizing(spark, [item(1)]) == 1
    many = [item(100 * g + i, f"G{g}") for g in range(6) for i in range(10)]
    # Pooled totals pass 25 with the third and the sixth group.
    assert sizing(spark, many) == 3
    assert sizing(spark, many, single=9) == 7


def test_only_the_first_aged_group_counts_for_its_age(spark):
    old = datetime(2016, 1, 1)
    rows = [item(g, f"G{g}", created=old) for g in range(4)]
    groups = work.backlog_by_object(items(spark, *rows))
    judged = work.classified_backlog(groups, as_of=NOW, single_threshold=25, total_threshold=25, age_hours=3)
    assert sorted((r.object_name, r.kind) for r in judged.collect()) == [
        ("G0", "aged"), ("G1", "pooled"), ("G2", "pooled"), ("G3", "pooled"),
    ]


def test_history_in_pieces_equals_the_whole(spark):
    rows = [(i, i % 3, NOW, None, "YNP"[i % 7 % 3], "c") for i in range(300)]
    whole = {r.notification_id: r for r in work.attempt_history(log(spark, *rows)).collect()}
    small = {r.notification_id: r for r in work.attempt_history(log(spark, *rows), ids_per_piece=16).collect()}
    assert whole == small
    assert whole[0].outcomes == ",".join("YNP"[i % 7 % 3] for i in range(0, 300, 3))


def test_round(spark):
    rows = [item(1), item(2), item(3), item(4)]
    attempts = [(10, 1, NOW, None, "P", "c"), (20, 2, NOW, None, "P", "c"), (30, 3, NOW, None, "P", "c")]
    attempts += [(i, 3, NOW, NOW, "N", "c") for i in (28, 29)]
    ended = spark.createDataFrame(
        [(10, 1, "Y", NOW), (20, 2, "N", NOW), (30, 3, "N", NOW)], "log_id int, id int, outcome string, end_time timestamp"
    )
    done = close_round(items(spark, *rows), log(spark, *attempts), ended, items(spark, item(9, wf=5)), 3)
    assert sorted(r.id for r in done.items.collect()) == [2, 4, 9]
    assert sorted(r.id for r in done.item_history.collect()) == [1, 3]
    assert [r.id for r in done.exhausted.collect()] == [3]
    assert {r.id: r.success for r in done.log.collect()} == {20: "N"}
    assert done.log_history.count() == 4


def test_rollup_of_large_ids_and_open_outcomes(spark, rows):
    log = spark.createDataFrame(
        [(2**56 + 3, 1, "N"), (5, 1, "Y"), (2**62, 2, "Y"), (2**62 + 1, 2, None)], "id long, notification_id long, success string"
    ).withColumn("date_processed", F.lit("2024-01-01").cast("timestamp"))
    found = work.attempt_rollup(log)
    assert rows(found.select("notification_id", "attempts", "last_outcome")) == [(1, 2, "N"), (2, 2, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
