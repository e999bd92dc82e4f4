"""Live leases as the state of a stream of requests.

Two keyed states follow each other. The first knows what each worker holds or
asked for last: of a worker's requests in a batch the last one counts, and a
request for something else gives up what the worker had. A worker that extends one
of several leases keeps the others until the batch is decided. The second knows who
holds each object: what is given up becomes free, the holder's own request extends the
lease by five minutes, and of other requests for a free object the earliest wins.
A timer ends a lease nobody extends. Both run on the time of the requests, so a
batch that runs again decides alike; for requests of one moment the decisions are
those of `operators.leases.request_decisions`.

An object sees one row per worker and batch, however often workers ask.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quayside.functions.names import OBJECT_KEY
from quayside.operators.leases import LEASE_MINUTES, WORKER
from quayside.operators.work import moment
from quayside.streaming.sinks import write_batch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEASE_MICROS = LEASE_MINUTES * 60 * 1_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OBJECT = ", ".join(f"{c} string" for c in OBJECT_KEY)
_WORKER = ", ".join(f"{c} string" for c in WORKER)
_MOVES = f"kind string, seq long, {_OBJECT}, {_WORKER}, wf_type int, at timestamp, micros long"
_EVENTS = f"event string, seq long, {_OBJECT}, {_WORKER}, wf_type int, micros long, expires long"
_WANTED = [*OBJECT_KEY, "wf_type"]


def _columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _plain(value):
    """A value of a pandas row as state takes it."""
    return None if pd.isna(value) else value.item() if hasattr(value, "item") else value


class _Timer:
    """One timer of a key, just behind the last moment something holds."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def set(self, until: int | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if until is not None:
            self.handle.registerTimer(until // 1000 + 1)


class Moves(StatefulProcessor):
    """Per worker: what it holds or asked for last, and until when that can hold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", f"{_OBJECT}, wf_type int, until long")
        self.timer = _Timer(handle)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # Many leases of a worker come in several frames.
        rows = [tuple(h) for h in self.held.get()] if self.held.exists() else []
        rows += [(*(_plain(row[c]) for c in _WANTED), int(row["expires"])) for _, row in initialState.iterrows()]
        self.held.put(rows)
        self.timer.set(max(r[-1] for r in rows))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for frame in rows:
            row = frame.loc[frame["seq"].idxmax()]
            if last is None or row["seq"] > last["seq"]:
                last = row
        wanted = tuple(_plain(last[c]) for c in _WANTED)
        out = [("request", int(last["seq"]), *wanted[:-1], *key, wanted[-1])]
        before = [tuple(h) for h in self.held.get()] if self.held.exists() else []
        # Only leases from before the stream are more than one; one of them that lives is an extension.
        extends = any(h[:-1] == wanted and h[-1] >= int(last["micros"]) for h in before)
        for held in before:
            if held[:-1] != wanted:
                out.append(("leave" if extends else "release", int(last["seq"]), *held[:-2], *key, held[-2]))
        until = int(last["micros"]) + LEASE_MICROS
        self.held.put([(*wanted, until)])
        self.timer.set(until)
        out = pd.DataFrame(out, columns=_columns(_MOVES)[:-2])
        yield out.assign(at=last["requested_at"], micros=int(last["micros"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Whatever the worker held has run out by itself.
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """Per object: who holds it, and until when."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lease = handle.getValueState("lease", f"{_WORKER}, wf_type int, expires long")
        self.timer = _Timer(handle)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.loc[initialState["expires"].idxmax()]
        self.lease.update((*(_plain(row[c]) for c in [*WORKER, "wf_type"]), int(row["expires"])))
        self.timer.set(int(row["expires"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moves = pd.concat(list(rows)).sort_values("seq")
        lease = tuple(self.lease.get()) if self.lease.exists() else None
        out = []
        for kind in ("release", "request", "leave"):
            for row in moves[moves["kind"] == kind].to_dict("records"):
                who = tuple(_plain(row[c]) for c in [*WORKER, "wf_type"])
                seq, micros = int(row["seq"]), int(row["micros"])
                if lease is not None and lease[-1] < micros:
                    lease = None
                own = lease is not None and lease[:-1] == who
                if kind != "request":
                    if own:
                        out.append(("released", seq, *key, *who, micros, None))
                        lease = None
                elif lease is None or own:
                    lease = (*who, micros + LEASE_MICROS)
                    out.append(("extended" if own else "granted", seq, *key, *lease[:-1], micros, lease[-1]))
                else:
                    out.append(("denied", seq, *key, *who, micros, None))
        if lease is None:
            self.lease.clear()
        else:
            self.lease.update(lease)
        self.timer.set(lease and lease[-1])
        yield _events(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lease = tuple(self.lease.get()) if self.lease.exists() else None
        self.lease.clear()
        yield _events([("expired", None, *key, *lease[:-1], lease[-1], lease[-1])] if lease else [])

    def close(self) -> None:
        pass


def _events(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_columns(_EVENTS))
    return frame.astype({"seq": "Int64", "wf_type": "Int32", "micros": "Int64", "expires": "Int64"})


@contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """A stream takes the store of its state from the session it starts in."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def lease_events(requests: DataFrame, leases: DataFrame | None = None, late: str = f"{LEASE_MINUTES} minutes") -> DataFrame:
    """What becomes of each worker's latest request, and of leases, in a stream.

    `requests` has `seq`, an object key, a worker, `wf_type` and `requested_at`; `leases`
    those there are before the stream starts. Events are `granted`, `extended` and
    `denied`, one per request that counts, `released` and `expired`, with `at` and
    `expiration_dt`. A request that comes later than `late` behind others is left out:
    a lease it could have got would be over.
    """
    spark = requests.sparkSession
    asked = requests.withColumn("micros", F.unix_micros("requested_at")).withWatermark("requested_at", late)
    if leases is None:
        known = spark.createDataFrame([], f"{_OBJECT}, {_WORKER}, wf_type int, expires long")
    else:
        known = leases.select(*OBJECT_KEY, *WORKER, "wf_type", F.unix_micros("expiration_dt").alias("expires"))
    moves = asked.groupBy(*WORKER).transformWithStateInPandas(
        Moves(), _MOVES, "Append", "EventTime", initialState=known.groupBy(*WORKER), eventTimeColumnName="at"
    )
    events = moves.groupBy(*OBJECT_KEY).transformWithStateInPandas(
        Leases(), _EVENTS, "Append", "EventTime", initialState=known.groupBy(*OBJECT_KEY)
    )
    return events.select(
        "event", "seq", *OBJECT_KEY, *WORKER, "wf_type",
        F.timestamp_micros("micros").alias("at"), F.timestamp_micros("expires").alias("expiration_dt"),
    )


def start_leases(
    requests: DataFrame, sink: str, checkpoint: str, leases: DataFrame | None = None, late: str = f"{LEASE_MINUTES} minutes", **trigger
) -> StreamingQuery:
    """Write the events of each batch to its own folder below `sink`.

    `leases` counts when the stream starts for the first time; from then on its
    checkpoint holds them.
    """
    with _state_in_rocksdb(requests.sparkSession):
        return (
            lease_events(requests, leases, late).writeStream.foreachBatch(lambda batch, number: write_batch(batch, sink, number))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def leases_after(events: DataFrame, leases: DataFrame, as_of) -> DataFrame:
    """The leases that live at `as_of`, from those before the stream and its events (with `batch`)."""
    # What an object's events do to its lease: the last counts, and within a batch giving up comes first.
    order = F.struct("batch", (F.col("event") != "released").alias("behind"))
    lease = F.struct(*WORKER, "wf_type", F.when(F.col("event").isin("granted", "extended"), F.col("expiration_dt")).alias("expiration_dt"))
    changed = events.where("event <> 'denied'").groupBy(*OBJECT_KEY).agg(F.max_by(lease, order).alias("lease"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in OBJECT_KEY]
    kept = leases.alias("l").join(changed.alias("c"), same, "left_anti").select(*OBJECT_KEY, *WORKER, "wf_type", "expiration_dt")
    return kept.unionByName(changed.select(*OBJECT_KEY, "lease.*")).where(F.col("expiration_dt") >= moment(as_of))
