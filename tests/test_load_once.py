"""Loads look up partitions once, and not at all for schema statements."""

import re

from lake_queries import plans
from lake_queries.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_schema_statements_need_no_registered_data(spark, monkeypatch):
    def never(lake):
        raise AssertionError("registered data was asked for")

    monkeypatch.setattr(plans, "latest", never)
    assert QUERIES["plan_load_schema_statements"](spark, SMALL).where("step > 1").count() == 0


def test_partitions_are_found_once(spark):
    plan = QUERIES["plan_load_all_statements"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(?<!file)_path#", plan)
