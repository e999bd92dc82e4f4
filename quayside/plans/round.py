"""One round over the work tables: outcomes in, retired items out, new work added."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators import work


@dataclass(frozen=True)
class Round:
    items: DataFrame
    log: DataFrame
    item_history: DataFrame
    log_history: DataFrame
    exhausted: DataFrame


def close_round(
    items: DataFrame, log: DataFrame, outcomes: DataFrame, added: DataFrame, max_attempts: int
) -> Round:
    """The work tables after attempts have ended.

    `outcomes` has `log_id`, `id` of the item, `outcome`, `end_time`. An attempt
    without an outcome stays open and its item stays. `added` are new items, such
    as statistics requests, with the columns of `items`.
    """
    closed = work.recorded_outcomes(log, outcomes)
    before = work.attempt_rollup(log).select(
        F.col("notification_id").alias("id"), (F.col("attempts") - 1).alias("retries")
    )
    latest = outcomes.groupBy("id").agg(
        F.max(F.struct("end_time", "log_id", "outcome"))["outcome"].alias("outcome")
    )
    judged = work.retirement(latest.join(before, "id"), max_attempts)
    retired = judged.where("fate <> 'retry'").select("id")
    kept, gone, kept_log, gone_log = work.archived(items, closed, retired)
    exhausted = items.join(judged.where("fate = 'exhausted'").select("id"), "id", "left_semi")
    return Round(
        kept.unionByName(added, allowMissingColumns=True), kept_log, gone, gone_log, exhausted
    )
