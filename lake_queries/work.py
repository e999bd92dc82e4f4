"""Work tracking: items, attempts, eligibility, leases, backlog, retirement."""

from __future__ import annotations

from pyspark.sql import functions as F

from lake_queries.registry import query
from lake_queries.tables import AS_OF
from quayside.functions import workflow
from quayside.functions.names import OBJECT_KEY
from quayside.functions.partitions import short_list
from quayside.operators import leases as lease_ops
from quayside.operators import work
from quayside.session import work_dir
from quayside.streaming import leases as lease_stream_ops

KEY = "namespace, object_name, usage_code, file_type"
MAX_ATTEMPTS, RETRY_SECONDS, CLUSTER = 5, 120, "C1"

ROLLUP = """rolled AS (
  SELECT notification_id, string_agg(success, ',' ORDER BY id, success) AS outcomes,
         count(*) AS attempts, max(date_processed) AS last_process
  FROM processing_log GROUP BY notification_id)"""


def eligible_sql(wanted: str, held: str) -> str:
    """Items never tried, or whose last attempt did not succeed and may be repeated by now.

    The last attempt has the greatest id, of equal ids the greatest outcome.
    """
    return f"""
WITH ended AS (
  SELECT notification_id AS id, max({{'i': id, 's': success}}).s AS ending, count(*) AS tries, max(date_processed) AS started
  FROM processing_log GROUP BY 1),
elsewhere AS (
  SELECT DISTINCT namespace, object_name, usage_code, file_type FROM leases
  WHERE cluster_id <> '{CLUSTER}' AND wf_type {held}),
ready AS (
  SELECT notifications.*, coalesce(tries, 0) AS attempts FROM notifications LEFT JOIN ended USING (id)
  WHERE wf_type {wanted} AND CASE WHEN tries IS NULL THEN true WHEN ending = 'Y' OR tries >= {MAX_ATTEMPTS} THEN false
    ELSE started < TIMESTAMP '{AS_OF}' - INTERVAL {RETRY_SECONDS} SECOND END)
SELECT ready.*, priority, coalesce(priority, -1) AS rank
FROM ready ANTI JOIN elsewhere USING (namespace, object_name, usage_code, file_type)
     LEFT JOIN workflows ON workflow_id = wf_type"""


def shown_sql(inner: str) -> str:
    return f"SELECT id, namespace, object_name, partition_values, wf_type, attempts, rank AS priority FROM ({inner})"


LOAD_SQL = eligible_sql("NOT IN (3, 5)", "NOT IN (3, 5)")
STATS_SQL = eligible_sql("= 5", "= 5")
WORK = "notifications processing_log workflows leases"


def eligible(lake, stats=False):
    return work.eligible_work(
        lake.notifications,
        lake.processing_log,
        lake.workflows,
        lake.leases,
        as_of=AS_OF,
        max_attempts=MAX_ATTEMPTS,
        retry_seconds=RETRY_SECONDS,
        cluster_id=CLUSTER,
        stats=stats,
    )


def listed(items):
    """Items in work order; an unknown priority shows as -1."""
    return work.in_work_order(items).select(
        "id", "namespace", "object_name", "partition_values", "wf_type", "attempts",
        F.coalesce("priority", F.lit(-1)).alias("priority"),
    )


@query("wrk1_eligible_load_work", shown_sql(LOAD_SQL), WORK)
def eligible_load_work(lake):
    return listed(eligible(lake))


@query("wrk2_eligible_stats_work", shown_sql(STATS_SQL), WORK)
def eligible_stats_work(lake):
    return listed(eligible(lake, stats=True))


@query(
    "wrk3_backlog",
    f"""
WITH {ROLLUP}
SELECT n.id, n.wf_type, coalesce(l.attempts, 0) AS attempts
FROM notifications n LEFT JOIN rolled l ON l.notification_id = n.id
WHERE n.wf_type NOT IN (3, 5)
  AND (l.outcomes IS NULL OR (l.outcomes LIKE '%N' AND l.attempts < {MAX_ATTEMPTS}))""",
    "notifications processing_log",
)
def backlog_items(lake):
    items = work.backlog(lake.notifications, lake.processing_log, max_attempts=MAX_ATTEMPTS)
    return items.select("id", "wf_type", "attempts")


@query(
    "wrk3_backlog_stats",
    f"""
WITH {ROLLUP}
SELECT n.id, coalesce(l.attempts, 0) AS attempts
FROM notifications n LEFT JOIN rolled l ON l.notification_id = n.id
WHERE n.wf_type = 5 AND (l.outcomes IS NULL OR (l.outcomes LIKE '%N' AND l.attempts < {MAX_ATTEMPTS}))""",
    "notifications processing_log",
)
def backlog_stats_items(lake):
    items = work.backlog(
        lake.notifications, lake.processing_log, max_attempts=MAX_ATTEMPTS, stats=True
    )
    return items.select("id", "attempts")


DECODED = """
SELECT n.id, replace(replace(replace(namespace, '.', '_'), ' ', '_'), '-', '_') AS database_name,
       coalesce(late, object_name) AS actual_object_name,
       replace(replace(replace(concat(coalesce(orig, late, object_name), '_', usage_code, '_', file_type),
               '.', '_'), ' ', '_'), '-', '_') AS table_name,
       contains(partition_values, ':') AS sub_partition_level,
       CASE WHEN contains(partition_values, ':') THEN replace(partition_values, ':', '|') END AS sub_values,
       cast(id AS varchar) AS execution_id, attempts AS retries
FROM (SELECT m.*, coalesce(l.attempts, 0) AS attempts,
             CASE WHEN json_valid(correlation_data) THEN correlation_data ->> '$.businessObject.late_reporting_for' END AS late,
             CASE WHEN json_valid(correlation_data) THEN correlation_data ->> '$.businessObject.original_object_name' END AS orig
      FROM notifications m LEFT JOIN (SELECT notification_id, count(*) AS attempts FROM processing_log
           GROUP BY notification_id) l ON l.notification_id = m.id) n"""


@query("wrk4_item_decoding", DECODED, "notifications processing_log")
def item_decoding(lake):
    decoded = work.decoded_items(work.with_attempts(lake.notifications, lake.processing_log))
    return decoded.select(
        "id",
        "database_name",
        "actual_object_name",
        "table_name",
        "sub_partition_level",
        F.array_join("sub_values", "|").alias("sub_values"),
        "execution_id",
        "retries",
    )


# Requests for leases: the workers of each cluster ask for the object of an order.
REQUESTS = f"""requests AS (
  SELECT id AS seq, {KEY}, 0 AS wf_type, concat('C', cast(id % 5 AS varchar)) AS cluster_id,
         concat('W', cast((id // 5) % 211 AS varchar)) AS worker_id FROM notifications)"""


def lease_requests(items):
    return items.select(
        F.col("id").alias("seq"),
        *OBJECT_KEY,
        F.lit(0).alias("wf_type"),
        F.concat(F.lit("C"), (F.col("id") % 5).cast("string")).alias("cluster_id"),
        F.concat(F.lit("W"), (F.floor(F.col("id") / 5) % 211).cast("string")).alias("worker_id"),
    )


MERGED = f"""
WITH {REQUESTS},
live AS (SELECT * FROM leases WHERE expiration_dt >= TIMESTAMP '{AS_OF}'),
asked AS (SELECT * FROM requests r WHERE seq = (SELECT max(seq) FROM requests x
          WHERE x.cluster_id = r.cluster_id AND x.worker_id = r.worker_id)),
ext AS (SELECT a.*, EXISTS (SELECT 1 FROM live l WHERE l.namespace = a.namespace AND l.object_name = a.object_name
        AND l.usage_code = a.usage_code AND l.file_type = a.file_type AND l.cluster_id = a.cluster_id
        AND l.worker_id = a.worker_id AND l.wf_type = a.wf_type) AS extended FROM asked a),
kept AS (SELECT * FROM live l WHERE NOT EXISTS (SELECT 1 FROM ext e WHERE e.cluster_id = l.cluster_id
         AND e.worker_id = l.worker_id)),
held AS (SELECT * FROM live l WHERE NOT EXISTS (SELECT 1 FROM ext e WHERE e.cluster_id = l.cluster_id
         AND e.worker_id = l.worker_id AND NOT e.extended)),
ranked AS (SELECT e.*, row_number() OVER (PARTITION BY {KEY} ORDER BY seq) AS rn FROM ext e
           WHERE NOT extended AND NOT EXISTS (SELECT 1 FROM held h WHERE h.namespace = e.namespace
           AND h.object_name = e.object_name AND h.usage_code = e.usage_code AND h.file_type = e.file_type))
SELECT {KEY}, cluster_id, worker_id, cast(wf_type AS int) AS wf_type, strftime(expiration_dt, '%Y-%m-%d %H:%M:%S') AS expires FROM kept
UNION ALL
SELECT {KEY}, cluster_id, worker_id, cast(wf_type AS int), '2001-06-01 00:05:00' FROM ext WHERE extended
UNION ALL
SELECT {KEY}, cluster_id, worker_id, cast(wf_type AS int), '2001-06-01 00:05:00' FROM ranked WHERE rn = 1"""


def shown_leases(leases):
    expires = F.date_format("expiration_dt", "yyyy-MM-dd HH:mm:ss").alias("expires")
    return leases.select(*OBJECT_KEY, "cluster_id", "worker_id", "wf_type", expires)


@query("wrk5_lease_merge", MERGED, "notifications leases")
def lease_merge(lake):
    return shown_leases(lease_ops.merged_leases(lake.leases, lease_requests(lake.notifications), AS_OF))


@query("stm3_lease_stream", MERGED, "notifications leases")
def lease_stream(lake):
    """The same requests as a stream; its state begins with the leases there are."""
    sink = work_dir(lake.spark, "lease-events")
    asked = lease_requests(lake.streamed("notifications", "orders")).withColumn("requested_at", F.lit(AS_OF).cast("timestamp"))
    lease_stream_ops.start_leases(asked, sink, work_dir(lake.spark, "leases"), lake.leases).awaitTermination()
    return shown_leases(lease_stream_ops.leases_after(lake.spark.read.parquet(sink), lake.leases, AS_OF))


@query(
    "wrk6_recorded_outcomes",
    """
WITH closing AS (SELECT l_orderkey * 10 + l_linenumber AS log_id, l_shipdate AS ended,
       CASE WHEN l_discount > 0.05 THEN 'Y' ELSE 'N' END AS outcome FROM lineitem WHERE l_tax > 0.04),
last AS (SELECT log_id, max({'e': ended, 'o': outcome}).o AS outcome FROM closing GROUP BY log_id)
SELECT p.id, p.notification_id, coalesce(l.outcome, p.success) AS success, count(*) AS attempts
FROM processing_log p LEFT JOIN last l ON l.log_id = p.id GROUP BY ALL""",
    "processing_log",
)
def recorded_outcomes(lake):
    closing = lake.lineitem.where("l_tax > 0.04").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("log_id"),
        F.col("l_shipdate").cast("timestamp").alias("end_time"),
        F.when(F.col("l_discount") > 0.05, "Y").otherwise("N").alias("outcome"),
    )
    log = work.recorded_outcomes(lake.processing_log, closing)
    return log.groupBy("id", "notification_id", "success").agg(F.count(F.lit(1)).alias("attempts"))


ATTEMPTED = """attempted AS (
  SELECT n.id, CASE WHEN o.o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS outcome,
         (SELECT count(*) FROM processing_log p WHERE p.notification_id = n.id) AS retries
  FROM notifications n JOIN orders o ON o.o_orderkey = n.id)"""


def attempted(lake):
    now = lake.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N").alias("outcome"),
    )
    tried = work.with_attempts(lake.notifications, lake.processing_log).join(now, "id")
    return tried.select("id", "outcome", F.col("attempts").alias("retries"))


@query(
    "wrk7_retirement",
    f"""
WITH {ATTEMPTED}
SELECT id, outcome, retries, CASE WHEN outcome = 'Y' THEN 'succeeded'
       WHEN retries >= {MAX_ATTEMPTS} - 1 THEN 'exhausted' ELSE 'retry' END AS fate FROM attempted""",
    "notifications processing_log",
)
def retirement(lake):
    return work.retirement(attempted(lake), MAX_ATTEMPTS)


@query(
    "wrk8_archive",
    f"""
WITH {ATTEMPTED}, gone AS (SELECT id FROM attempted WHERE outcome = 'Y' OR retries >= {MAX_ATTEMPTS} - 1)
SELECT 'item' AS kind, id AS item_id, id IN (SELECT id FROM gone) AS archived, cast(1 AS bigint) AS n FROM notifications
UNION ALL
SELECT 'attempt', notification_id, notification_id IN (SELECT id FROM gone), count(*) FROM processing_log GROUP BY 2, 3""",
    "notifications processing_log",
)
def archive(lake):
    gone = work.retirement(attempted(lake), MAX_ATTEMPTS).where("fate <> 'retry'")
    items, old_items, log, old_log = work.archived(lake.notifications, lake.processing_log, gone)

    def shown(df, kind, key, is_archived):
        counted = df.groupBy(F.col(key).alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
        return counted.select(
            F.lit(kind).alias("kind"), "item_id", F.lit(is_archived).alias("archived"), "n"
        )

    return (
        shown(items, "item", "id", False)
        .unionByName(shown(old_items, "item", "id", True))
        .unionByName(shown(log, "attempt", "notification_id", False))
        .unionByName(shown(old_log, "attempt", "notification_id", True))
    )


# Joins, aggregates and filters the above are made of -------------------------


@query(
    "jn1_items_with_attempts",
    """
SELECT n.id, coalesce(l.attempts, 0) AS attempts, strftime(l.last_process, '%Y-%m-%d') AS last_day
FROM notifications n LEFT JOIN (SELECT notification_id, count(*) AS attempts, max(date_processed) AS last_process
     FROM processing_log GROUP BY notification_id) l ON l.notification_id = n.id""",
    "notifications processing_log",
)
def items_with_attempts(lake):
    tried = work.with_attempts(lake.notifications, lake.processing_log)
    return tried.select(
        "id", "attempts", F.date_format("last_process", "yyyy-MM-dd").alias("last_day")
    )


@query(
    "jn2_items_with_priority",
    "SELECT n.id, n.wf_type, coalesce(w.priority, -1) AS priority FROM notifications n LEFT JOIN workflows w ON n.wf_type = w.workflow_id",
    "notifications workflows",
)
def items_with_priority(lake):
    return work.with_priority(lake.notifications, lake.workflows).select(
        "id", "wf_type", F.coalesce("priority", F.lit(-1)).alias("priority")
    )


NOT_LEASED = """
SELECT n.id FROM notifications n WHERE NOT EXISTS (SELECT 1 FROM leases c
 WHERE c.namespace = n.namespace AND c.object_name = {name} AND c.usage_code = n.usage_code
   AND c.file_type = n.file_type AND c.cluster_id <> 'C1' AND c.wf_type NOT IN (3, 5))"""


@query("jn3_not_leased_elsewhere", NOT_LEASED.format(name="n.object_name"), "notifications leases")
def not_leased(lake):
    return work.not_leased_elsewhere(lake.notifications, lake.leases, CLUSTER).select("id")


@query(
    "jn3_not_leased_by_actual_name",
    NOT_LEASED.format(
        name="coalesce(CASE WHEN json_valid(n.correlation_data) "
        "THEN n.correlation_data ->> '$.businessObject.late_reporting_for' END, n.object_name)"
    ),
    "notifications leases",
)
def not_leased_actual(lake):
    free = work.not_leased_elsewhere(
        lake.notifications, lake.leases, CLUSTER, match_on="actual"
    )
    return free.select("id")


@query(
    "agg1_attempt_history",
    f"WITH {ROLLUP} SELECT notification_id, outcomes, attempts, strftime(last_process, '%Y-%m-%d') AS last_day FROM rolled",
    "processing_log",
)
def attempt_history(lake):
    history = work.attempt_history(lake.processing_log)
    return history.select(
        "notification_id", "outcomes", "attempts", F.date_format("last_process", "yyyy-MM-dd").alias("last_day")
    )


GROUPS = f"""groups AS (
  SELECT {KEY}, count(*) AS items, min(date_created) AS oldest
  FROM (SELECT n.* FROM notifications n LEFT JOIN (SELECT notification_id, count(*) AS attempts,
          max({{'id': id, 's': success}}).s AS last FROM processing_log GROUP BY 1) l ON l.notification_id = n.id
        WHERE n.wf_type NOT IN (3, 5) AND (l.last IS NULL OR (l.last = 'N' AND l.attempts < {MAX_ATTEMPTS})))
  GROUP BY ALL)"""


def backlog_groups(lake):
    items = work.backlog(lake.notifications, lake.processing_log, max_attempts=MAX_ATTEMPTS)
    return work.backlog_by_object(items)


@query(
    "agg2_backlog_by_object",
    f"WITH {GROUPS} SELECT {KEY}, items, strftime(oldest, '%Y-%m-%d') AS oldest FROM groups",
    "notifications processing_log",
)
def backlog_by_object(lake):
    return backlog_groups(lake).withColumn("oldest", F.date_format("oldest", "yyyy-MM-dd"))


SINGLE, TOTAL, AGE, UNITS = 25, 60, 50000, 40

CLASSIFIED = f"""
WITH RECURSIVE {GROUPS},
g AS (SELECT *, items > {SINGLE} AS hot, NOT (items > {SINGLE}) AND
        (epoch(TIMESTAMP '{AS_OF}') - epoch(oldest))::BIGINT // 3600 > {AGE} AS aged,
        row_number() OVER (ORDER BY {KEY}) AS rn FROM groups),
k AS (SELECT *, CASE WHEN hot THEN 'hot' WHEN aged AND rn = (SELECT min(rn) FROM g WHERE aged) THEN 'aged'
        ELSE 'pooled' END AS kind FROM g),
f AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS total, false AS adds
      UNION ALL
      SELECT k.rn, CASE WHEN k.kind <> 'pooled' THEN f.total WHEN f.total + k.items > {TOTAL} THEN 0 ELSE f.total + k.items END,
             k.kind <> 'pooled' OR f.total + k.items > {TOTAL}
      FROM f JOIN k ON k.rn = f.rn + 1)"""


def classified(lake):
    return work.classified_backlog(
        backlog_groups(lake),
        as_of=AS_OF,
        single_threshold=SINGLE,
        total_threshold=TOTAL,
        age_hours=AGE,
    )


@query(
    "agg3_backlog_classes",
    f"{CLASSIFIED} SELECT {KEY}, items, kind, adds AS adds_unit FROM k JOIN f USING (rn)",
    "notifications processing_log",
)
def backlog_classes(lake):
    return classified(lake).select(*OBJECT_KEY, "items", "kind", "adds_unit")


@query(
    "agg3_backlog_sizing",
    f"""{CLASSIFIED} SELECT count(*) AS groups,
  least(greatest(count(*) FILTER (adds) + CASE WHEN count(*) > 1 THEN 1 ELSE 0 END, 1), {UNITS})::BIGINT AS units
  FROM f WHERE rn > 0""",
    "notifications processing_log",
)
def backlog_sizing(lake):
    return work.backlog_sizing(classified(lake), UNITS)


ORDERED = f"""e AS (SELECT * FROM ({LOAD_SQL}))"""
MINE = """row_number() OVER (ORDER BY priority ASC NULLS FIRST, partition_values DESC NULLS LAST, id) AS rn"""


@query(
    "ord1_next_batch",
    f"""
WITH {ORDERED},
o AS (SELECT *, {MINE}, coalesce(CASE WHEN json_valid(correlation_data)
        THEN correlation_data ->> '$.businessObject.late_reporting_for' END, object_name) AS actual FROM e),
free AS (SELECT min(rn) AS rn FROM o WHERE NOT EXISTS (SELECT 1 FROM leases c WHERE c.namespace = o.namespace
   AND c.object_name = o.actual AND c.usage_code = o.usage_code AND c.file_type = o.file_type
   AND c.expiration_dt >= TIMESTAMP '{AS_OF}' AND NOT (c.cluster_id = 'C1' AND c.worker_id = 'W1'))),
head AS (SELECT o.* FROM o JOIN free USING (rn)),
tail AS (SELECT o.id, o.rn, (o.namespace, o.object_name, o.usage_code, o.file_type, o.wf_type) =
        (h.namespace, h.object_name, h.usage_code, h.file_type, h.wf_type) AS same
        FROM o, head h WHERE o.rn >= h.rn)
SELECT id FROM tail WHERE rn < coalesce((SELECT min(rn) FROM tail WHERE NOT same), 1e18)""",
    WORK,
)
def next_batch(lake):
    batch = work.next_batch(
        eligible(lake), lake.leases, cluster_id=CLUSTER, worker_id="W1", as_of=AS_OF
    )
    return batch.select("id")


@query("flt4_load_and_stats_types", "SELECT id, wf_type, wf_type NOT IN (3, 5) AS load, wf_type = 5 AS stats FROM notifications", "notifications")
def workflow_types(lake):
    wf = F.col("wf_type")
    return lake.notifications.select(
        "id", "wf_type", workflow.is_load(wf).alias("load"), workflow.is_stats(wf).alias("stats")
    )


@query(
    "flt5_last_outcome",
    f"WITH {ROLLUP} SELECT notification_id, outcomes LIKE '%Y' AS succeeded, outcomes LIKE '%N' AS failed FROM rolled",
    "processing_log",
)
def last_outcome(lake):
    rolled = work.attempt_rollup(lake.processing_log)
    return rolled.select(
        "notification_id",
        (F.col("last_outcome") == "Y").alias("succeeded"),
        (F.col("last_outcome") == "N").alias("failed"),
    )


@query(
    "flt6_retry_due",
    f"""WITH {ROLLUP} SELECT notification_id FROM rolled WHERE attempts < {MAX_ATTEMPTS}
    AND date_diff('second', last_process, TIMESTAMP '{AS_OF}') > {RETRY_SECONDS}""",
    "processing_log",
)
def retry_due(lake):
    rolled = work.attempt_rollup(lake.processing_log)
    return rolled.where(work.retry_due(AS_OF, MAX_ATTEMPTS, RETRY_SECONDS)).select("notification_id")


@query("flt7_purge", "SELECT id, wf_type IN (3, 33) AS purged FROM notifications", "notifications")
def purge(lake):
    kept, purged = work.purge_unprocessed(lake.notifications)
    return kept.select("id", F.lit(False).alias("purged")).unionByName(
        purged.select("id", F.lit(True).alias("purged"))
    )


@query(
    "flt8_expired_leases",
    f"SELECT object_name, expiration_dt < TIMESTAMP '{AS_OF}' AS expired FROM leases",
    "leases",
)
def expired_leases(lake):
    live, expired = lease_ops.split_expired(lake.leases, AS_OF)
    return live.select("object_name", F.lit(False).alias("expired")).unionByName(
        expired.select("object_name", F.lit(True).alias("expired"))
    )


@query(
    "flt9_same_execution",
    "SELECT id, execution_id, partition_values FROM notifications WHERE execution_id = 'exec-17'",
    "notifications",
)
def same_execution(lake):
    return work.submitted_by(lake.notifications, "exec-17").select(
        "id", "execution_id", "partition_values"
    )


@query(
    "srt1_work_order",
    f"SELECT id, {MINE} FROM notifications n LEFT JOIN workflows w ON n.wf_type = w.workflow_id",
    "notifications workflows",
)
def work_order(lake):
    """Positions in work order: ranks inside range partitions plus the rows before each."""
    from quayside.operators.ordering import numbered

    items = work.with_priority(lake.notifications, lake.workflows).select(
        "id", "priority", "partition_values"
    )
    return numbered(items, work.work_order(), "rn").select("id", "rn")


@query(
    "srt4_latest_checkpoint",
    "SELECT id, date_diff('minute', date_processed, TIMESTAMP '2024-02-01 00:00:00') AS age FROM processing_log ORDER BY id DESC, date_processed DESC LIMIT 1",
    "processing_log",
)
def latest_checkpoint(lake):
    points = lake.processing_log.withColumnRenamed("date_processed", "processed_dt")
    return work.checkpoint_age(points, "2024-02-01 00:00:00")


@query(
    "srt5_short_lists",
    """SELECT id, CASE WHEN contains(v, ',') THEN concat(array_to_string(string_split(v, ',')[1:5], ','), '...') ELSE v END AS shown
    FROM (SELECT notification_id AS id, string_agg(success, ',' ORDER BY id, success) AS v FROM processing_log GROUP BY 1)""",
    "processing_log",
)
def short_lists(lake):
    history = work.attempt_history(lake.processing_log)
    return history.select(
        F.col("notification_id").alias("id"), short_list(F.col("outcomes")).alias("shown")
    )


@query(
    "stm3_live_heartbeats",
    """
SELECT user_id, strftime(max(ts) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS expires
FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 5 MINUTE > TIMESTAMP '2024-01-30 12:00:00'""",
)
def live_heartbeats(lake):
    beats = lake.events.select(
        F.lit("ns").alias("namespace"),
        F.col("user_id").cast("string").alias("object_name"),
        F.lit("PRC").alias("usage_code"),
        F.lit("TXT").alias("file_type"),
        F.lit("C1").alias("cluster_id"),
        F.col("user_id").cast("string").alias("worker_id"),
        F.col("ts").cast("timestamp").alias("heartbeat"),
    )
    held = lease_ops.held_from_heartbeats(beats, "2024-01-30 12:00:00")
    return held.select(
        F.col("object_name").cast("long").alias("user_id"),
        F.date_format("expiration_dt", "yyyy-MM-dd HH:mm:ss").alias("expires"),
    )
