"""Leases on objects, kept as a table.

A merge of one batch of requests; it is no mutex between processes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.names import OBJECT_KEY
from quayside.operators.work import moment

WORKER = ["cluster_id", "worker_id"]
LEASE_MINUTES = 5


def split_expired(leases: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Live and expired leases."""
    over = F.col("expiration_dt") < moment(as_of)
    return leases.where(~over), leases.where(over)


def _expiry(as_of):
    return moment(as_of) + F.make_dt_interval(mins=F.lit(LEASE_MINUTES))


def request_decisions(leases: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Each worker's latest request with `extended` and `granted`.

    A request has `seq`, the object key, a workflow and a worker. A worker that
    holds exactly this lease extends it. Any other request gives up what the
    worker holds; the earliest request on an object nobody else holds gets it.
    """
    live, _ = split_expired(leases, as_of)
    # `seq` and the workflow are enough to find the request again.
    latest = requests.groupBy(*WORKER).agg(F.max("seq").alias("seq"))
    asked = requests.join(latest, [*WORKER, "seq"], "left_semi")
    exact = [*OBJECT_KEY, *WORKER, "wf_type"]
    own = live.select(*exact).withColumn("extended", F.lit(True))
    marked = asked.join(own, exact, "left").withColumn(
        "extended", F.coalesce("extended", F.lit(False))
    )
    movers = marked.where(~F.col("extended")).select(*WORKER)
    held = live.join(movers, WORKER, "left_anti").select(*OBJECT_KEY)
    winners = (
        marked.where(~F.col("extended"))
        .join(held, OBJECT_KEY, "left_anti")
        .groupBy(*OBJECT_KEY)
        .agg(F.min("seq").alias("seq"))
        .withColumn("_won", F.lit(True))
    )
    return marked.join(winners, [*OBJECT_KEY, "seq"], "left").select(
        *requests.columns,
        "extended",
        (F.col("extended") | F.coalesce("_won", F.lit(False))).alias("granted"),
    )


def merged_leases(leases: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """The lease table after one batch of requests; expired leases are gone."""
    live, _ = split_expired(leases, as_of)
    decided = request_decisions(leases, requests, as_of)
    kept = live.join(decided.select(*WORKER).distinct(), WORKER, "left_anti")
    granted = decided.where("granted").select(
        *OBJECT_KEY, *WORKER, "wf_type", _expiry(as_of).alias("expiration_dt")
    )
    columns = [*OBJECT_KEY, *WORKER, "wf_type", "expiration_dt"]
    return kept.select(*columns).unionByName(granted)


def held_from_heartbeats(heartbeats: DataFrame, as_of) -> DataFrame:
    """Leases alive by their last heartbeat."""
    last = heartbeats.groupBy(*OBJECT_KEY, *WORKER).agg(F.max("heartbeat").alias("heartbeat"))
    until = F.col("heartbeat") + F.make_dt_interval(mins=F.lit(LEASE_MINUTES))
    return last.withColumn("expiration_dt", until).where(F.col("expiration_dt") > moment(as_of))
