"""Workflow codes and the labels that go with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Workflow codes of work items.
MANAGED, SINGLETON, DISABLED, STATS, DROP, BACK_LOAD, INTERMEDIATE = 0, 1, 3, 5, 7, 8, 33
NOT_PROCESSED = [DISABLED, INTERMEDIATE]

# Job names carried by registrations.
MANAGED_JOB = "addPartitionWorkflow"
SINGLETON_JOB = "singletonObjectsAddPartitionWorkflow"
MAIL_ONLY_JOB = "emailDisabledObjectsWorkflow"


def is_load(wf_type: Column) -> Column:
    return ~wf_type.isin(DISABLED, STATS)


def is_stats(wf_type: Column) -> Column:
    return wf_type == STATS


def is_unpartitioned_singleton(wf_type: Column, partition_key: Column) -> Column:
    return (wf_type == SINGLETON) & (F.lower(partition_key) == "partition")


def is_partitioned_singleton(wf_type: Column, partition_key: Column) -> Column:
    return (wf_type == SINGLETON) & (F.lower(partition_key) != "partition")


def classification(wf_type: Column, partition_key: Column) -> Column:
    return (
        F.when(wf_type == MANAGED, "managed")
        .when(wf_type == STATS, "stats")
        .when(is_unpartitioned_singleton(wf_type, partition_key), "unpartitioned singleton")
        .when(is_partitioned_singleton(wf_type, partition_key), "partitioned singleton")
        .otherwise("other")
    )


def processor(wf_type: Column) -> Column:
    """Which processing a work item gets; null where none exists."""
    return (
        F.when(wf_type.isin(MANAGED, SINGLETON), "add partition")
        .when(wf_type == STATS, "gather stats")
        .when(wf_type == DROP, "drop table")
        .when(wf_type == BACK_LOAD, "back load")
    )


def action_label(wf_type: Column) -> Column:
    """Action named in failure reports; a back-load counts as adding partitions."""
    return (
        F.when(wf_type == STATS, "Gather Stats")
        .when(wf_type == DROP, "Drop Table")
        .otherwise("Add Partition")
    )


def code_for_job(job_name: Column, partition_value: Column | None = None) -> Column:
    """Workflow code a manual request gets; null where the job cannot be back-loaded."""
    given = F.lit(False) if partition_value is None else F.coalesce(partition_value != "", F.lit(False))
    return (
        F.when(job_name == SINGLETON_JOB, SINGLETON)
        .when((job_name == MANAGED_JOB) & given, MANAGED)
        .when(job_name == MANAGED_JOB, BACK_LOAD)
    )


def age_in_hours(created: Column, as_of: Column) -> Column:
    """Whole hours between the two, cut towards zero."""
    return F.timestamp_diff("HOUR", created.cast("timestamp"), as_of.cast("timestamp"))


def older_than(created: Column, as_of: Column, hours: int) -> Column:
    return age_in_hours(created, as_of) > hours
