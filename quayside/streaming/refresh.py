"""Re-evaluation of pending work as the work log changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quayside.streaming.sinks import write_batch


def start_refresh(
    changes: DataFrame,
    pending: Callable[[int], DataFrame],
    sink: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Write the pending work after each batch of changes.

    `pending` gets the batch number and reads the work tables as they are; a
    processing-time trigger sets the interval, `availableNow` stops when idle.
    """

    def take(batch: DataFrame, number: int) -> None:
        write_batch(pending(number), sink, number)

    return (
        changes.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
