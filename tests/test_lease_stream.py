"""Leases kept as the state of a stream."""

from __future__ import annotations

import datetime
import random

import pytest

from quayside.functions.names import OBJECT_KEY
from quayside.operators import leases as batch
from quayside.streaming import leases as stream

REQUEST = "seq long, namespace string, object_name string, usage_code string, file_type string, cluster_id string, worker_id string, wf_type int"
LEASE = REQUEST.removeprefix("seq long, ") + ", expiration_dt timestamp"
START = datetime.datetime(2024, 1, 1, 12, 0, 0)


def moments(count):
    return [START + datetime.timedelta(seconds=130 * k) for k in range(count)]


def made_requests(count, seed):
    """Batches of requests of one moment each."""
    rng, seq, out, last = random.Random(seed), 0, [], {}
    for k in range(count):
        rows = []
        for _ in range(rng.randrange(1, 9)):
            seq, worker = seq + 1, f"w{rng.randrange(5)}"
            wanted = last.get(worker) if rng.random() < 0.5 else None
            last[worker] = wanted or (rng.choice("ABCD"), rng.choice([0, 0, 0, 5]))
            rows.append((seq, "ns", last[worker][0], "PRC", "TXT", "c", worker, last[worker][1]))
        out.append(rows)
    return out


def tuples(df, *columns):
    return sorted((tuple(str(v) for v in r) for r in df.select(*columns).collect()))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_decides_as_merges_do_across_restarts(spark, tmp_path):
    batches, at = made_requests(6, 3), moments(6)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    before = spark.createDataFrame(
        [("ns", "A", "PRC", "TXT", "c", "w1", 0, START + datetime.timedelta(seconds=100)), ("ns", "B", "PRC", "TXT", "d", "w9", 0, START),
         ("ns", "C", "PRC", "TXT", "c", "w1", 0, START + datetime.timedelta(seconds=500)), ("ns", "D", "PRC", "TXT", "d", "w8", 0, START - datetime.timedelta(1))],
        LEASE)
    schema = spark.createDataFrame([], REQUEST + ", requested_at timestamp").schema
    leases, want = before, []
    for k, (rows, now) in enumerate(zip(batches, at)):
        asked = spark.createDataFrame(rows, REQUEST)
        spark.createDataFrame([(*r, now) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
        decided = batch.request_decisions(leases, asked, str(now))
        want += [(r.seq, "extended" if r.extended else "granted" if r.granted else "denied") for r in decided.collect()]
        leases = spark.createDataFrame(batch.merged_leases(leases, asked, str(now)).collect(), LEASE)
        if k % 3 == 2:  # the stream goes on from its checkpoint, several batches at a time
            read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            stream.start_leases(read, sink, str(tmp_path / "cp"), before).awaitTermination()
    events = spark.read.parquet(sink)
    got = [(r.seq, r.event) for r in events.where("event in ('granted', 'extended', 'denied')").collect()]
    assert sorted(got) == sorted(want)
    columns = [*OBJECT_KEY, "cluster_id", "worker_id", "wf_type", "expiration_dt"]
    live = batch.split_expired(leases, str(at[-1]))[0]
    assert tuples(stream.leases_after(events, before, str(at[-1])), *columns) == tuples(live, *columns)
    assert {e for _, e in got} == {"granted", "extended", "denied"}


def test_timers_end_leases(spark, tmp_path):
    """A lease nobody extends ends by its timer, and its object is free again."""
    schema = spark.createDataFrame([], REQUEST + ", requested_at timestamp").schema
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")

    def send(seq, name, worker, seconds):
        row = (seq, "ns", name, "PRC", "TXT", "c", worker, 0, START + datetime.timedelta(seconds=seconds))
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(schema).parquet(source)
        stream.start_leases(read, sink, str(tmp_path / "cp"), late="1 second").awaitTermination()

    for request in ((1, "A", "w1", 0), (2, "A", "w2", 250), (3, "A", "w1", 299), (4, "B", "w3", 900), (5, "A", "w2", 901), (6, "A", "w3", 902)):
        send(*request)
    found = spark.read.parquet(sink).orderBy("batch", "at")
    assert [(r.event, r.seq, r.object_name, r.worker_id) for r in found.collect() if r.event != "released"] == [
        ("granted", 1, "A", "w1"), ("denied", 2, "A", "w2"), ("extended", 3, "A", "w1"), ("granted", 4, "B", "w3"),
        ("expired", None, "A", "w1"), ("granted", 5, "A", "w2"), ("denied", 6, "A", "w3")]
    assert [(r.object_name, r.worker_id) for r in found.where("event = 'released'").collect()] == [("B", "w3")]


def test_extending_keeps_the_other_leases_until_the_batch_is_decided(spark, tmp_path):
    """What a worker holds besides the lease it extends is denied to others, as in a merge, and free afterwards."""
    later = START + datetime.timedelta(seconds=200)
    before = spark.createDataFrame([("ns", name, "PRC", "TXT", "c", "w1", 0, later) for name in "ABC"], LEASE)
    rows = [(1, "ns", "B", "PRC", "TXT", "c", "w2", 0), (2, "ns", "A", "PRC", "TXT", "c", "w1", 0), (3, "ns", "D", "PRC", "TXT", "c", "w3", 0)]
    asked = spark.createDataFrame(rows, REQUEST)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], REQUEST + ", requested_at timestamp").schema
    spark.createDataFrame([(*r, START) for r in rows], schema).coalesce(1).write.parquet(source)
    stream.start_leases(spark.readStream.schema(schema).parquet(source), sink, str(tmp_path / "cp"), before).awaitTermination()
    events = spark.read.parquet(sink)
    decided = batch.request_decisions(before, asked, str(START)).collect()
    want = {r.seq: "extended" if r.extended else "granted" if r.granted else "denied" for r in decided}
    assert want == {1: "denied", 2: "extended", 3: "granted"}
    assert {r.seq: r.event for r in events.where("event <> 'released'").collect()} == want
    columns = [*OBJECT_KEY, "cluster_id", "worker_id", "wf_type", "expiration_dt"]
    after = batch.merged_leases(before, asked, str(START))
    assert tuples(stream.leases_after(events, before, str(START)), *columns) == tuples(after, *columns)


def test_leases_of_a_worker_in_several_frames(spark, tmp_path):
    """All of them are given up, however the rows of a worker are cut."""
    later, schema = START + datetime.timedelta(seconds=200), spark.createDataFrame([], REQUEST + ", requested_at timestamp").schema
    before = spark.createDataFrame([("ns", f"o{k}", "PRC", "TXT", "c", "w1", 0, later) for k in range(7)], LEASE)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "ns", "X", "PRC", "TXT", "c", "w1", 0, START)], schema).coalesce(1).write.parquet(source)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        stream.start_leases(spark.readStream.schema(schema).parquet(source), sink, str(tmp_path / "cp"), before).awaitTermination()
    finally:
        spark.conf.set(name, kept)
    events = spark.read.parquet(sink)
    assert {r.object_name for r in events.where("event = 'released'").collect()} == {f"o{k}" for k in range(7)}
