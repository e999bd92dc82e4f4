"""Status-change events become work items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quayside.functions import workflow
from quayside.streaming.repeats import without_repeats
from quayside.streaming.sinks import write_batch

# The two kinds of events.
DATA_EVENT, STORAGE_EVENT = "BUS_OBJCT_DATA_STTS_CHG", "STRGE_UNIT_STTS_CHG"
FILTERS = ["object_name", "usage_code", "file_type", "new_status", "storage_name"]


def work_items(
    events: DataFrame, registrations: DataFrame, cluster_name: str = "loader"
) -> DataFrame:
    """A work item per event and enabled registration it matches.

    A filter a registration leaves out matches anything. Only a few combinations
    of left-out filters exist, 32 at most; an event asks once per combination
    with those fields blank, so the match is an equi-join without candidates to
    discard.
    """
    code = F.when(F.col("job_name") == workflow.MANAGED_JOB, workflow.MANAGED).when(
        F.col("job_name") == workflow.SINGLETON_JOB, workflow.SINGLETON
    )
    blank = F.array(*[F.col(f).isNull() for f in FILTERS])
    asked = (
        registrations.where("status = 'ENABLED'")
        .withColumn("wf_type", code)
        .where("wf_type is not null")
        .withColumn("_blank", blank)
    )
    combinations = [r["_blank"] for r in asked.select("_blank").distinct().collect()]
    keys = ["namespace", "event_type", "_blank", *[f"_{f}" for f in FILTERS]]
    right = asked.select(
        "notification_name", "namespace", "event_type", "_blank", "wf_type", "correlation_data",
        *[F.coalesce(f, F.lit("")).alias(f"_{f}") for f in FILTERS],
    )
    choices = F.array(*[F.array(*[F.lit(b) for b in c]) for c in combinations]) if combinations else (
        F.array().cast("array<array<boolean>>")
    )
    opened = events.withColumn("_blank", F.explode(choices))
    left = opened.select(
        "*",
        *[
            F.when(F.get("_blank", at), "").otherwise(F.col(f)).alias(f"_{f}")
            for at, f in enumerate(FILTERS)
        ],
    )
    matched = left.join(right, keys)
    return matched.select(
        "event_id", "notification_name", "namespace", "object_name", "usage_code", "file_type",
        "partition_key", F.col("partition_value").alias("partition_values"), "wf_type",
        "correlation_data",
        F.concat_ws("-", "notification_name", F.col("event_id").cast("string")).alias("execution_id"),
        F.lit(cluster_name).alias("cluster_name"),
    )


def start_arrivals(
    events: DataFrame,
    registrations: Callable[[], DataFrame],
    sink: str,
    checkpoint: str,
    repeats_within: str | None = None,
    event_time: str = "event_time",
    **trigger,
) -> StreamingQuery:
    """Append work items for a stream of events.

    Registrations are read anew for every batch, so a change takes effect with
    the next one. A batch that runs again replaces its own output. With
    `repeats_within`, an event that is delivered again within that time of its
    `event_time` counts once, in whatever batch it comes.
    """
    if repeats_within is not None:
        events = without_repeats(events, ["event_id"], event_time, repeats_within)

    def take(batch: DataFrame, number: int) -> None:
        write_batch(work_items(batch, registrations()), sink, number)

    return (
        events.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
