"""Leases over time, from the heartbeats of the workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.names import OBJECT_KEY
from quayside.operators.leases import LEASE_MINUTES, WORKER


def lease_history(heartbeats: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Spans in which a worker held an object, in a batch or a stream.

    A heartbeat keeps the lease five minutes; one that comes later opens a new
    span. In a stream a span is final once the watermark has passed its end.

    In a batch the beats of one minute, which always belong together, are first
    combined, so that a worker with most of the rows sends few of them on.
    """
    lease = LEASE_MINUTES * 60 * 1_000_000
    if heartbeats.isStreaming:
        marked = heartbeats.withWatermark("heartbeat", late).withColumn("_beats", F.lit(1).cast("long"))
        span = F.session_window("heartbeat", f"{LEASE_MINUTES} minutes")
    else:
        marked = (
            heartbeats.groupBy(*OBJECT_KEY, *WORKER, F.date_trunc("minute", "heartbeat").alias("_minute"))
            .agg(
                F.min("heartbeat").alias("heartbeat"),
                F.max("heartbeat").alias("_last"),
                F.count(F.lit(1)).alias("_beats"),
            )
        )
        lasting = F.unix_micros("_last") - F.unix_micros("heartbeat") + F.lit(lease)
        span = F.session_window("heartbeat", F.concat(lasting.cast("string"), F.lit(" microseconds")))
    return (
        marked.groupBy(span.alias("span"), *OBJECT_KEY, *WORKER)
        .agg(F.sum("_beats").alias("beats"))
        .select(
            *OBJECT_KEY, *WORKER,
            F.col("span.start").alias("acquired"), F.col("span.end").alias("expires"), "beats",
        )
    )
