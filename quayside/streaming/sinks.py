"""Output of one micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_batch(df: DataFrame, sink: str, number: int) -> None:
    """Write a batch to its own folder, so that running it again changes nothing."""
    df.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")
