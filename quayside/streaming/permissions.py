"""Permission changes become grants and revokes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quayside.operators import access
from quayside.streaming.repeats import without_repeats
from quayside.streaming.sinks import write_batch

# Fields of the message a permission change sends.
MESSAGE = "action string, userId string, namespace string"
DELTA, FULL = "delta_sync", "full_sync"


def _opened(messages: DataFrame, column: str) -> DataFrame:
    body = F.from_json(F.col(column).cast("string"), MESSAGE)
    whole = F.col("m.action") == FULL
    both = (F.length("m.namespace") > 0) & (F.length("m.userId") > 0)
    valid = F.coalesce(whole | ((F.col("m.action") == DELTA) & both), F.lit(False))
    return messages.select(F.col(column).cast("string").alias("message"), body.alias("m")).select(
        "message", "m", whole.alias("whole"), valid.alias("valid")
    )


def parsed_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Changed pairs; a message for a full sync counts as one for everybody.

    A message for one change must name both a namespace and a user.
    """
    return _opened(messages, column).where("valid").select(
        F.when(F.col("whole"), "").otherwise(F.col("m.namespace")).alias("namespace"),
        F.when(F.col("whole"), access.EVERYBODY).otherwise(F.col("m.userId")).alias("user_id"),
    )


def rejected_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages that cannot be read, of unknown action or without both fields."""
    return _opened(messages, column).where("not valid").select("message")


def start_permission_sync(
    messages: DataFrame,
    permissions: Callable[[], DataFrame],
    table_names: Callable[[], DataFrame],
    grants: Callable[[], DataFrame],
    sink: str,
    checkpoint: str,
    databases: Callable[[], DataFrame] | None = None,
    schema_root: str = "",
    repeats_within: str | None = None,
    message_key: str = "message_id",
    event_time: str = "event_time",
    **trigger,
) -> StreamingQuery:
    """Write the grant changes each batch of messages calls for.

    Rejected messages go to `<sink>-rejected`; with `databases`, schemas that
    changed users lack go to `<sink>-schemas`.

    A change is judged by the permissions as they are now, so several messages
    on one pair in a batch need one answer. With `repeats_within`, a message whose
    `message_key` was seen within that time of its `event_time` is not answered again.
    """
    if repeats_within is not None:
        messages = without_repeats(messages, [message_key], event_time, repeats_within)

    def take(batch: DataFrame, number: int) -> None:
        changes = parsed_messages(batch).distinct()
        write_batch(access.delta_sync(changes, permissions(), table_names(), grants()), sink, number)
        write_batch(rejected_messages(batch), f"{sink}-rejected", number)
        if databases is not None:
            write_batch(access.changed_user_schemas(changes, databases(), schema_root), f"{sink}-schemas", number)

    return (
        messages.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
