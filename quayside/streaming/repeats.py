"""Messages that a queue delivers more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def without_repeats(messages: DataFrame, keys: list[str], event_time: str, within: str) -> DataFrame:
    """The first of the messages with equal `keys`, in a stream or a batch.

    A stream remembers a key until `within` has passed on the time of the messages, so
    its state holds the keys of that time only. In a batch all repeats go.
    """
    if not messages.isStreaming:
        return messages.dropDuplicates(keys)
    return messages.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)
