"""Registered queries against their checking SQL, a few per area.

`check.py` compares all of them.
"""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import comparable
from lake_queries.tables import GIVEN

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "wrk1_eligible_load_work", "wrk5_lease_merge", "agg1_attempt_history", "agg3_backlog_sizing", "ord1_next_batch",
    "srt1_work_order", "ord2_weighted_chunks", "ord3_chunk_encoding", "prt4_selected_partitions", "prt7_back_load_plan",
    "scl6_partition_values", "scl16_columns_of_definition", "sch4_change_plan", "sch6_change_reports",
    "agg5_partition_profile", "acl2_full_sync", "acl5_role_of_database", "acl12_decisions", "wrk10_registration_effects",
    "stm1_work_items_from_stream", "stm3_lease_history", "src1_delimited_scan", "src7_format_registrations",
    "snk4_delete_rows", "sch5_stored_versions", "agg5_merged_profile", "agg5_weekday_profile", "ord5_latest_at_creation", "prt8_submitted_spans",
    "prt8_strict_resubmission", "plan_load_left_out", "jn4_nested_role_members", "acl12_nested_decisions", "agg6_storage_listing",
    "stm1_work_items_without_repeats",
]


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for name in GIVEN:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, database, name):
    got = queries()[name](spark, FOLDER).toPandas()
    want = database.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert comparable(got).equals(comparable(want))


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 140


def test_entry(spark):
    assert entry(spark).count() > 0
