"""Registration requests, business metadata, and events matched to registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lake_queries.registry import query
from quayside.functions.names import OBJECT_KEY
from quayside.operators import metadata
from quayside.operators import registration as ops
from quayside.session import work_dir
from quayside.sources import documents
from quayside.streaming import arrivals, heartbeats

FIELD = "trim(split_part(line, '|', {}))"
PARSED = f"""parsed AS (SELECT line_no, line, {FIELD.format(1)} AS namespace, {FIELD.format(2)} AS object_name,
    {FIELD.format(3)} AS usage_code, {FIELD.format(4)} AS file_type, {FIELD.format(5)} AS workflow, {FIELD.format(6)} AS action,
    {FIELD.format(7)} AS json_file FROM requests WHERE NOT regexp_matches(line, '^\\s*(#|namespace|$)'))"""
JUDGED = f"""{PARSED}, judged AS (SELECT p.*, regexp_replace(concat(namespace, '_', object_name, '_', usage_code, '_', file_type), '[. -]', '_', 'g') AS notification_name,
    CASE WHEN regexp_matches(line, '[^A-Za-z0-9|_.\\- ]') THEN 'Line contains bad characters.'
      WHEN '' IN (namespace, object_name, usage_code, file_type, workflow, action) THEN 'Missing expected parameter from line.'
      WHEN json_file <> '' AND j.json_file IS NULL THEN 'Expected json file not present.'
      WHEN json_file <> '' AND NOT json_valid(content) THEN 'The json file contains formatting errors.'
      WHEN workflow NOT IN ('DM Managed', 'Singleton') THEN 'Invalid workflow type provided.'
      WHEN action NOT IN ('add', 'drop', 'enable', 'disable') THEN 'Invalid action provided.' ELSE '' END AS reason
  FROM parsed p LEFT JOIN json_files j USING (json_file)),
accepted AS (SELECT * FROM judged WHERE reason = '')"""


def parsed(lake):
    return documents.parsed_requests(lake.requests)


def judged(lake):
    return ops.validated(parsed(lake), lake.json_files)


@query(
    "src8_registration_requests",
    f"WITH {PARSED} SELECT line, namespace, object_name, usage_code, file_type, workflow, action, json_file FROM parsed",
    "requests",
)
def registration_requests(lake):
    place = work_dir(lake.spark, "requests")
    lake.requests.select("line").write.text(place)
    return documents.scan_requests(lake.spark, place).drop("place")


@query(
    "wrk9_request_lines",
    f"WITH {PARSED} SELECT row_number() OVER (ORDER BY line_no) AS line_no, line, action FROM parsed",
    "requests",
)
def request_lines(lake):
    place = work_dir(lake.spark, "ordered")
    lake.requests.orderBy("line_no").select("line").write.text(place)
    found = documents.line_numbers(documents.scan_requests(lake.spark, place))
    return found.select("line_no", "line", "action")


@query(
    "wrk9_request_validation",
    f"WITH {JUDGED} SELECT line_no, notification_name, reason FROM judged",
    "requests json_files",
)
def request_validation(lake):
    return judged(lake).select(
        "line_no", "notification_name", F.coalesce("reason", F.lit("")).alias("reason")
    )


LAST = "SELECT *, row_number() OVER (PARTITION BY notification_name ORDER BY line_no DESC) AS rn FROM accepted"
JOB = "CASE workflow WHEN 'Singleton' THEN 'singletonObjectsAddPartitionWorkflow' ELSE 'addPartitionWorkflow' END"
KEY = "namespace, object_name, usage_code, file_type"


# Objects whose number is divisible by three have no registered format.
POSSIBLE = """accepted AS (SELECT * FROM requested r WHERE action = 'drop' OR cast(regexp_extract(object_name, '([0-9]+)$', 1) AS bigint) % 3 <> 0
      OR (notification_name IN (SELECT notification_name FROM existing_registrations)
          AND notification_name NOT IN (SELECT notification_name FROM requested WHERE action = 'drop')))"""


@query(
    "wrk10_registration_effects",
    f"""WITH {JUDGED.replace("accepted AS", "requested AS")}, {POSSIBLE}, last AS (SELECT * FROM ({LAST}) WHERE rn = 1),
    storage AS (SELECT * FROM ({LAST} WHERE action = 'drop' OR workflow = 'DM Managed') WHERE rn = 1),
    events AS (SELECT s.*, e.suffix, e.st FROM storage s, (VALUES ('_ARCHIVE', 'ARCHIVING'), ('_RESTORE', 'RESTORED'), ('_EXPIRE', 'EXPIRING')) e(suffix, st))
    SELECT notification_name, {KEY}, kind, status_filter, job_name, status FROM existing_registrations WHERE notification_name NOT IN (
      SELECT notification_name FROM last UNION ALL SELECT notification_name || '_EMAIL' FROM last UNION ALL SELECT notification_name || suffix FROM events)
    UNION ALL SELECT notification_name, {KEY}, 'data', '', {JOB}, CASE action WHEN 'disable' THEN 'DISABLED' ELSE 'ENABLED' END FROM last WHERE action <> 'drop'
    UNION ALL SELECT notification_name || '_EMAIL', {KEY}, 'data', '', 'emailDisabledObjectsWorkflow', 'ENABLED' FROM last WHERE action = 'disable'
    UNION ALL SELECT notification_name || suffix, {KEY}, 'storage', st, {JOB}, 'ENABLED' FROM events WHERE action <> 'drop'""",
    "requests json_files existing_registrations",
)
def registration_effects(lake):
    accepted, _ = ops.split_requests(judged(lake))
    number = F.regexp_extract("object_name", "([0-9]+)$", 1).cast("long")
    formats = accepted.where(number % 3 != 0).select(*OBJECT_KEY).distinct()
    return ops.merged_registrations(lake.existing_registrations, accepted, order="line_no", formats=formats)


@query(
    "wrk10_drop_items",
    f"WITH {JUDGED} SELECT {KEY}, 7 AS wf_type, 'drop' AS execution_id, '' AS partition_values FROM accepted WHERE action = 'drop'",
    "requests json_files",
)
def drop_items(lake):
    accepted, _ = ops.split_requests(judged(lake))
    return ops.drop_items(accepted)


@query(
    "wrk11_back_load_status",
    f"""WITH {JUDGED} SELECT line_no, CASE WHEN action NOT IN ('add', 'enable') THEN 'invalid action' WHEN reason <> '' THEN 'not submitted'
      WHEN workflow IN ('DM Managed', 'Singleton') THEN 'submitted' ELSE 'invalid workflow' END AS back_load FROM judged""",
    "requests json_files",
)
def back_load_status(lake):
    return ops.back_load_status(judged(lake)).select("line_no", "back_load")


@query(
    "jn9_described_columns",
    """SELECT c.table_name, c.name, coalesce(b.p_name, '') AS business_name FROM old_columns c
    LEFT JOIN (SELECT concat('t', cast(cast(floor(p_partkey / 20) AS bigint) AS varchar)) AS table_name,
        concat(lower(p_type), '_', cast(p_partkey % 20 AS varchar)) AS name, p_name FROM part) b
      ON b.table_name = c.table_name AND b.name = c.name WHERE NOT c.is_partition""",
    "old_columns",
)
def described_columns(lake):
    columns = lake.old_columns.where(~F.col("is_partition")).select(
        F.lit("ns").alias("namespace"), F.col("table_name").alias("object_name"), "name", "ordinal"
    )
    given = lake.part.select(
        F.lit("ns").alias("namespace"),
        F.concat(F.lit("t"), F.floor(F.col("p_partkey") / 20).cast("string")).alias("object_name"),
        F.concat(F.lower("p_type"), F.lit("_"), (F.col("p_partkey") % 20).cast("string")).alias("schema_column_name"),
        F.col("p_name").alias("business_name"),
        F.lit("").alias("description"),
    )
    described = metadata.described_columns(columns, given)
    return described.select(
        F.col("object_name").alias("table_name"), "name",
        F.coalesce("business_name", F.lit("")).alias("business_name"),
    )


@query(
    "jn9_tagged_objects",
    """SELECT s_suppkey, coalesce(t.tag, '') AS tag FROM supplier LEFT JOIN (
      SELECT DISTINCT l_suppkey, concat(l_returnflag, l_linestatus) AS tag FROM lineitem) t ON l_suppkey = s_suppkey""",
)
def tagged_objects(lake):
    objects = lake.supplier.select(F.lit("ns").alias("namespace"), F.col("s_suppkey").alias("object_name"))
    tags = lake.lineitem.select(
        F.lit("ns").alias("namespace"), F.col("l_suppkey").alias("object_name"),
        F.concat("l_returnflag", "l_linestatus").alias("tag"),
    ).distinct()
    tagged = metadata.tagged_objects(objects, tags)
    return tagged.select(F.col("object_name").alias("s_suppkey"), F.coalesce("tag", F.lit("")).alias("tag"))


# Events --------------------------------------------------------------------

MATCHED = """
SELECT e.event_id, r.notification_name, e.object_name, e.partition_value AS partition_values,
  CASE r.job_name WHEN 'addPartitionWorkflow' THEN 0 ELSE 1 END AS wf_type, r.correlation_data
FROM arrivals e JOIN arrival_registrations r ON r.namespace = e.namespace AND r.event_type = e.event_type
  AND coalesce(r.object_name, e.object_name) = e.object_name AND coalesce(r.usage_code, e.usage_code) = e.usage_code
  AND coalesce(r.file_type, e.file_type) = e.file_type AND coalesce(r.new_status, e.new_status) = e.new_status
  AND coalesce(r.storage_name, e.storage_name) = e.storage_name
WHERE r.status = 'ENABLED' AND r.job_name IN ('addPartitionWorkflow', 'singletonObjectsAddPartitionWorkflow')"""
ITEM = ["event_id", "notification_name", "object_name", "partition_values", "wf_type", "correlation_data"]


@query("stm1_work_items_from_events", MATCHED, "arrivals arrival_registrations")
def work_items_from_events(lake):
    return arrivals.work_items(lake.arrivals, lake.arrival_registrations).select(*ITEM)


@query("stm1_work_items_from_stream", MATCHED, "arrivals arrival_registrations")
def work_items_from_stream(lake):
    """The same through a stream that reads all events there are and stops."""
    sink = work_dir(lake.spark, "items")
    started = arrivals.start_arrivals(
        lake.streamed("arrivals", "events"),
        lambda: lake.arrival_registrations,
        sink,
        work_dir(lake.spark, "arrivals"),
    )
    started.awaitTermination()
    return lake.spark.read.parquet(sink).select(*ITEM)


@query("stm1_work_items_without_repeats", MATCHED, "arrivals arrival_registrations")
def work_items_without_repeats(lake):
    """Every event delivered twice, half of them in another batch; items as from one delivery."""
    source, sink = work_dir(lake.spark, "deliveries"), work_dir(lake.spark, "items")
    told = lake.arrivals.join(lake.events.select("event_id", F.col("ts").cast("timestamp").alias("event_time")), "event_id")
    again = told.where("event_id % 2 = 0")
    checkpoint = work_dir(lake.spark, "arrivals")
    # The stream takes what is there as one batch, and goes on from its checkpoint with the next delivery.
    for number, delivered in enumerate((told.unionByName(told.where("event_id % 2 = 1")), again), 1):
        delivered.write.parquet(f"{source}/batch={number}")
        stream = lake.spark.readStream.schema(told.schema).parquet(f"{source}/batch=*")
        # Deliveries of a whole history follow each other here, so all of it is remembered.
        arrivals.start_arrivals(
            stream, lambda: lake.arrival_registrations, sink, checkpoint, repeats_within="100 years"
        ).awaitTermination()
    return lake.spark.read.parquet(sink).select(*ITEM)


@query(
    "stm4_storage_lifecycle_items",
    f"""SELECT m.event_id, m.notification_name, a.new_status FROM ({MATCHED}) m JOIN arrivals a USING (event_id)
    WHERE a.event_type = 'STRGE_UNIT_STTS_CHG' AND a.new_status IN ('ARCHIVING', 'RESTORED', 'EXPIRING')""",
    "arrivals arrival_registrations",
)
def storage_lifecycle_items(lake):
    events = lake.arrivals.where(
        (F.col("event_type") == arrivals.STORAGE_EVENT)
        & F.col("new_status").isin("ARCHIVING", "RESTORED", "EXPIRING")
    )
    items = arrivals.work_items(events, lake.arrival_registrations)
    return items.join(events.select("event_id", "new_status"), "event_id").select(
        "event_id", "notification_name", "new_status"
    )


HISTORY = """
WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS span FROM b)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS acquired, strftime(max(ts) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS expires,
  count(*) AS beats FROM s GROUP BY user_id, span"""


def beats(events):
    return events.select(
        F.lit("ns").alias("namespace"), F.col("user_id").cast("string").alias("object_name"),
        F.lit("PRC").alias("usage_code"), F.lit("TXT").alias("file_type"),
        F.lit("C1").alias("cluster_id"), F.col("user_id").cast("string").alias("worker_id"),
        F.col("ts").cast("timestamp").alias("heartbeat"),
    )


def spans_shown(history):
    shown = "yyyy-MM-dd HH:mm:ss"
    return history.select(
        F.col("object_name").cast("long").alias("user_id"),
        F.date_format("acquired", shown).alias("acquired"),
        F.date_format("expires", shown).alias("expires"),
        "beats",
    )


@query("stm3_lease_history", HISTORY)
def lease_history(lake):
    return spans_shown(heartbeats.lease_history(beats(lake.events)))


@query("stm3_lease_history_stream", HISTORY)
def lease_history_stream(lake):
    """As a stream; a beat long after all others lets the watermark pass every span."""
    source, sink = work_dir(lake.spark, "beats"), work_dir(lake.spark, "spans")
    all_beats = beats(lake.events)
    last = all_beats.agg(F.max("heartbeat").alias("heartbeat")).select(
        *[F.lit("-1").alias(c) for c in all_beats.columns[:-1]], (F.col("heartbeat") + F.expr("interval 30 days")).alias("heartbeat")
    )
    all_beats.unionByName(last).write.parquet(source)
    started = (
        heartbeats.lease_history(lake.spark.readStream.schema(all_beats.schema).parquet(source))
        .writeStream.format("parquet").option("path", sink).option("checkpointLocation", work_dir(lake.spark, "spans-state"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spans_shown(lake.spark.read.parquet(sink))
