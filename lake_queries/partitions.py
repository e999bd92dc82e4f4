"""Registered data, chunks, back-loads, partition changes, statistics requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lake_queries.registry import query
from lake_queries.scalars import EXPANDED
from lake_queries.tables import AS_OF_DATE
from quayside.functions import partitions as pv
from quayside.functions import workflow
from quayside.functions.names import OBJECT_KEY
from quayside.operators import partitions as ops
from quayside.session import stable

KEY = "namespace, object_name, usage_code, file_type"
CHUNK = 100

LATEST = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY}, partition_value, sub_value
  ORDER BY format_version DESC, data_version DESC, status DESC, file_path DESC) AS rn
  FROM object_data WHERE status = 'VALID') WHERE rn = 1)"""
WEIGHTS = f"""weights AS (SELECT {KEY}, partition_value, 1 + count(DISTINCT sub_value) AS weight
  FROM latest GROUP BY ALL)"""
# Rows are numbered per object in string order and folded one position at a time.
CHUNKS = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY partition_value) AS rn FROM weights),
chunks AS (
  SELECT {KEY}, partition_value, rn, 0::BIGINT AS chunk_no,
         CASE WHEN weight >= {CHUNK} THEN 1 ELSE 0 END AS closes, weight AS total FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.namespace, n.object_name, n.usage_code, n.file_type, n.partition_value, n.rn, c.chunk_no + c.closes,
         CASE WHEN CASE WHEN c.closes = 1 THEN 0 ELSE c.total END + n.weight >= {CHUNK} THEN 1 ELSE 0 END,
         CASE WHEN c.closes = 1 THEN 0 ELSE c.total END + n.weight
  FROM chunks c JOIN numbered n ON n.object_name = c.object_name AND n.rn = c.rn + 1)"""


def latest(lake):
    return ops.latest_valid(lake.registered_data)


def weights(lake):
    return ops.partition_weights(latest(lake))


@query(
    "ord4_latest_valid",
    f"WITH {LATEST} SELECT {KEY}, partition_value, coalesce(sub_value, '') AS sub, format_version, data_version, file_path FROM latest",
    "object_data",
)
def latest_valid(lake):
    return latest(lake).select(
        *OBJECT_KEY, "partition_value",
        F.coalesce(F.array_join("sub_partition_values", ":"), F.lit("")).alias("sub"),
        "format_version", "data_version", "file_path",
    )


@query(
    "ord5_latest_before",
    f"""SELECT {KEY}, max(partition_value) AS partition_value FROM object_data
    WHERE partition_value <= '1999-06-02' GROUP BY ALL""",
    "object_data",
)
def latest_before(lake):
    return ops.latest_before(lake.registered_data, F.lit("1999-06-01").cast("date"))


@query(
    "ord5_latest_at_creation",
    f"""WITH newest AS (SELECT {KEY}, partition_value, max(file_path) AS path FROM object_data GROUP BY ALL)
    SELECT n.id, coalesce(o.partition_value, '') AS latest_value, coalesce(o.path, '') AS latest_path
    FROM (SELECT *, strftime(date_created + INTERVAL 1 DAY, '%Y-%m-%d') AS upto FROM notifications) n
    ASOF LEFT JOIN newest o ON o.namespace = n.namespace AND o.object_name = n.object_name AND o.usage_code = n.usage_code
      AND o.file_type = n.file_type AND o.partition_value <= n.upto""",
    "notifications object_data",
)
def latest_at_creation(lake):
    """Each work item with the newest partition its object had when it was created."""
    items = lake.notifications.select("id", *OBJECT_KEY, "date_created")
    found = ops.latest_at(items, lake.registered_data, F.col("date_created"))
    return found.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("latest_value", "latest_path")])


@query(
    "agg4_sub_partition_union",
    f"SELECT DISTINCT {KEY}, partition_value, coalesce(sub_value, '') AS sub_value FROM object_data",
    "object_data",
)
def sub_partition_union(lake):
    return ops.sub_partition_union(lake.registered_data).withColumn(
        "sub_value", F.coalesce("sub_value", F.lit(""))
    )


@query(
    "agg4_partition_weights",
    f"WITH {LATEST}, {WEIGHTS} SELECT * FROM weights",
    "object_data",
)
def partition_weights(lake):
    return weights(lake)


@query(
    "ord2_weighted_chunks",
    f"WITH RECURSIVE {LATEST}, {WEIGHTS}, {CHUNKS} SELECT {KEY}, partition_value, chunk_no FROM chunks",
    "object_data",
)
def weighted_chunks(lake):
    return ops.weighted_chunks(weights(lake), CHUNK).select(
        *OBJECT_KEY, "partition_value", "chunk_no"
    )


ENCODED = f"""packed AS (SELECT {KEY}, chunk_no, min(partition_value) AS first, max(partition_value) AS last,
   string_agg(partition_value, ',' ORDER BY partition_value DESC) AS listed FROM chunks GROUP BY ALL),
encoded AS (SELECT p.*, is_date, CASE WHEN is_date THEN concat(last, '__', coalesce(lag(last) OVER (
   PARTITION BY p.object_name ORDER BY chunk_no), first)) ELSE listed END AS partition_values
   FROM packed p JOIN date_keyed d USING ({KEY}))"""


@query(
    "ord3_chunk_encoding",
    f"WITH RECURSIVE {LATEST}, {WEIGHTS}, {CHUNKS}, {ENCODED} SELECT {KEY}, chunk_no, partition_values FROM encoded",
    "object_data date_keyed",
)
def chunk_encoding(lake):
    chunks = ops.weighted_chunks(weights(lake), CHUNK).join(lake.date_keyed, OBJECT_KEY)
    return ops.encoded_chunks(chunks, OBJECT_KEY, "is_date")


# A back-load request per object; its id also names what it has submitted so far.
REQUESTS = f"""asked AS (SELECT {KEY}, max(id) AS id, any_value('tdate') AS partition_key FROM notifications
   WHERE wf_type = 8 GROUP BY ALL),
done AS (SELECT cast(a.id AS varchar) AS execution_id, n.partition_values FROM notifications n JOIN asked a USING ({KEY})),
seen AS (SELECT DISTINCT execution_id, unnest(CASE WHEN contains(partition_values, ',') THEN string_split(partition_values, ',')
    WHEN contains(partition_values, '__') THEN string_split(partition_values, '__') ELSE [] END) AS partition_value FROM done)"""


def back_load_requests(lake):
    return lake.notifications.where("wf_type = 8").groupBy(*OBJECT_KEY).agg(
        F.max("id").alias("id"),
        F.lit("tdate").alias("partition_key"),
        F.lit("").alias("correlation_data"),
        F.lit("cl").alias("cluster_name"),
    )


def submitted_so_far(lake):
    asked = back_load_requests(lake).select(*OBJECT_KEY, F.col("id").cast("string").alias("execution_id"))
    return lake.notifications.drop("execution_id").join(asked, OBJECT_KEY)


@query(
    "prt8_resubmission_filter",
    f"""WITH {LATEST}, {REQUESTS}
    SELECT DISTINCT l.object_name, l.partition_value, cast(a.id AS varchar) AS execution_id,
           EXISTS (SELECT 1 FROM seen s WHERE s.execution_id = cast(a.id AS varchar) AND s.partition_value = l.partition_value) AS seen
    FROM latest l JOIN asked a USING ({KEY})""",
    "object_data notifications",
)
def resubmission_filter(lake):
    asked = back_load_requests(lake).select(*OBJECT_KEY, F.col("id").cast("string").alias("execution_id"))
    wanted = latest(lake).select(*OBJECT_KEY, "partition_value").distinct().join(asked, OBJECT_KEY)
    done = submitted_so_far(lake)
    columns = ["object_name", "partition_value", "execution_id"]
    fresh = ops.without_submitted(wanted, done).select(*columns, F.lit(False).alias("seen"))
    return fresh.unionByName(
        ops.already_submitted(wanted, done).select(*columns, F.lit(True).alias("seen"))
    )


# Days spelled out, counted, and put together again where they follow each other.
SPANS = f"""days AS (SELECT execution_id, d::DATE AS day, count(*) AS times FROM (
    SELECT execution_id, unnest(CASE
      WHEN contains(v, '__') AND split_part(v, '__', 2) < split_part(v, '__', 1)
        THEN generate_series(cast(split_part(v, '__', 2) AS TIMESTAMP), cast(split_part(v, '__', 1) AS TIMESTAMP), INTERVAL 1 DAY)
      WHEN contains(v, '__') THEN [cast(split_part(v, '__', 1) AS TIMESTAMP)]
      WHEN contains(v, ',') THEN list_transform(string_split(v, ','), lambda x: try_cast(x AS TIMESTAMP))
      ELSE [try_cast(v AS TIMESTAMP)] END) AS d FROM (SELECT execution_id, partition_values AS v FROM done))
    WHERE d IS NOT NULL GROUP BY ALL),
kinds AS (
    SELECT execution_id, 'submitted' AS kind, day FROM days UNION ALL SELECT execution_id, 'overlapping', day FROM days WHERE times > 1
    UNION ALL SELECT DISTINCT cast(a.id AS varchar), 'missing', cast(l.partition_value AS DATE) FROM latest l JOIN asked a USING ({KEY})
    WHERE l.partition_value <> 'none' AND NOT EXISTS (
      SELECT 1 FROM days d WHERE d.execution_id = cast(a.id AS varchar) AND d.day = cast(l.partition_value AS DATE)))"""


@query(
    "prt8_submitted_spans",
    f"""WITH {LATEST}, {REQUESTS}, {SPANS}
    SELECT execution_id, kind, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day
    FROM (SELECT *, day - cast(row_number() OVER (PARTITION BY execution_id, kind ORDER BY day) AS INT) AS run FROM kinds)
    GROUP BY execution_id, kind, run""",
    "object_data notifications",
)
def submitted_spans(lake):
    """What each back-load request has asked for so far, where it repeats itself, and what is left."""
    asked = back_load_requests(lake).select(*OBJECT_KEY, F.col("id").cast("string").alias("execution_id"))
    available = latest(lake).select(*OBJECT_KEY, "partition_value").join(asked, OBJECT_KEY).where("partition_value <> 'none'")
    found = ops.submitted_spans(submitted_so_far(lake), available, ["execution_id"])
    return found.select("execution_id", "kind", *[F.col(c).cast("string").alias(c) for c in ("first_day", "last_day")])


@query(
    "prt8_strict_resubmission",
    f"""WITH {LATEST}, {REQUESTS}, {SPANS}
    SELECT DISTINCT l.object_name, l.partition_value, cast(a.id AS varchar) AS execution_id,
           EXISTS (SELECT 1 FROM days d WHERE d.execution_id = cast(a.id AS varchar) AND cast(d.day AS varchar) = l.partition_value)
           OR EXISTS (SELECT 1 FROM done d WHERE d.execution_id = cast(a.id AS varchar) AND d.partition_values = l.partition_value) AS seen
    FROM latest l JOIN asked a USING ({KEY})""",
    "object_data notifications",
)
def strict_resubmission(lake):
    """Partitions that a span or value of their request covers, and those that are left."""
    asked = back_load_requests(lake).select(*OBJECT_KEY, F.col("id").cast("string").alias("execution_id"))
    wanted = latest(lake).select(*OBJECT_KEY, "partition_value").distinct().join(asked, OBJECT_KEY)
    found = ops.with_submitted(wanted, submitted_so_far(lake), strict=True)
    return found.select("object_name", "partition_value", "execution_id", "seen")


PLAN = f"""survivors AS (SELECT c.*, a.id FROM chunks c JOIN asked a USING ({KEY}) WHERE NOT EXISTS (
   SELECT 1 FROM seen s WHERE s.execution_id = cast(a.id AS varchar) AND s.partition_value = c.partition_value)),
packed AS (SELECT {KEY}, id, chunk_no, min(partition_value) AS first, max(partition_value) AS last,
   string_agg(partition_value, ',' ORDER BY partition_value DESC) AS listed FROM survivors GROUP BY ALL),
plan AS (SELECT p.*, CASE WHEN coalesce(is_date, false) THEN concat(last, '__', coalesce(lag(last) OVER (
   PARTITION BY p.object_name ORDER BY chunk_no), first)) ELSE listed END AS partition_values
   FROM packed p LEFT JOIN date_keyed d USING ({KEY}))"""


@query(
    "prt7_back_load_plan",
    f"""WITH RECURSIVE {LATEST}, {WEIGHTS}, {CHUNKS}, {REQUESTS}, {PLAN}
    SELECT {KEY}, cast(id AS varchar) AS execution_id, chunk_no, partition_values FROM plan
    UNION ALL SELECT {KEY}, cast(id AS varchar), -1, '' FROM asked a WHERE NOT EXISTS (SELECT 1 FROM latest l
      WHERE l.object_name = a.object_name)""",
    "object_data date_keyed notifications",
)
def back_load_plan(lake):
    plan = ops.back_load_plan(
        back_load_requests(lake), lake.registered_data, submitted_so_far(lake), lake.date_keyed, CHUNK
    )
    return plan.select(
        *OBJECT_KEY, "execution_id",
        F.coalesce("chunk_no", F.lit(-1)).alias("chunk_no"),
        F.coalesce("partition_values", F.lit("")).alias("partition_values"),
    )


# Loading -------------------------------------------------------------------

PART_NAME = "concat('tdate=', partition_value, CASE WHEN sub_value IS NULL THEN '' ELSE concat('/region=', sub_value) END)"


def named(data):
    """Registered data with its table and canonical partition name."""
    subs = F.array_join("sub_partition_values", "/region=")
    name = F.concat(
        F.lit("tdate="), "partition_value",
        F.when(F.col("sub_partition_values").isNull(), "").otherwise(F.concat(F.lit("/region="), subs)),
    )
    return data.select(
        F.col("object_name").alias("table_name"), "partition_value", name.alias("part_name"),
        F.col("file_path").alias("location"),
    )


def existing(lake):
    """Partitions the tables have now: the oldest file of each registered partition."""
    oldest = lake.registered_data.where("status = 'ARCHIVED'").groupBy(
        *OBJECT_KEY, "partition_value", "sub_partition_values"
    ).agg(F.min("file_path").alias("file_path"))
    return named(oldest)


EXISTING = f"""existing AS (SELECT object_name AS table_name, partition_value, {PART_NAME} AS part_name, min(file_path) AS location
   FROM object_data WHERE status = 'ARCHIVED' GROUP BY ALL)"""
FRESH = f"""fresh AS (SELECT object_name AS table_name, partition_value, {PART_NAME} AS part_name, file_path AS location FROM latest)"""


@query(
    "prt1_added_partitions",
    f"""WITH {LATEST}, {EXISTING}, {FRESH}, {EXPANDED},
    wanted AS (SELECT DISTINCT n.object_name AS table_name, wanted_value AS partition_value FROM expanded JOIN notifications n USING (id)),
    added AS (SELECT f.* FROM fresh f JOIN wanted USING (table_name, partition_value))
    SELECT table_name, part_name, location FROM added
    UNION ALL SELECT table_name, part_name, location FROM existing e WHERE NOT EXISTS (
      SELECT 1 FROM added a WHERE a.table_name = e.table_name AND a.part_name = e.part_name)""",
    "object_data notifications",
)
def added_partitions(lake):
    wanted = ops.requested_partitions(lake.notifications).select(
        F.col("object_name").alias("table_name"), F.col("wanted_value").alias("partition_value")
    )
    requested = named(latest(lake)).join(wanted.distinct(), ["table_name", "partition_value"])
    return ops.added_partitions(existing(lake), requested)


@query(
    "prt2_singleton_refresh",
    f"""WITH {LATEST}, {EXISTING}, {FRESH},
    newest AS (SELECT table_name, max(partition_value) AS partition_value FROM fresh WHERE partition_value <= '2001-06-02' GROUP BY 1),
    added AS (SELECT f.table_name, f.partition_value, f.part_name, f.location FROM fresh f JOIN newest USING (table_name, partition_value)
       WHERE f.table_name IN (SELECT object_name FROM date_keyed WHERE NOT is_date))
    SELECT table_name, part_name, location FROM added
    UNION ALL SELECT table_name, part_name, location FROM existing e WHERE NOT EXISTS (SELECT 1 FROM added a
      WHERE a.table_name = e.table_name AND (a.part_name = e.part_name OR e.partition_value > '1970-01-01'))""",
    "object_data date_keyed",
)
def singleton_refresh(lake):
    data = stable(latest(lake))
    newest = ops.latest_before(data, F.lit(AS_OF_DATE).cast("date"))
    # Objects whose key is no date are the singletons here.
    singletons = lake.date_keyed.where("not is_date").select(*OBJECT_KEY)
    chosen = named(data.join(newest, [*OBJECT_KEY, "partition_value"]).join(singletons, OBJECT_KEY, "left_semi"))
    return ops.refreshed_singletons(existing(lake), chosen).select("table_name", "part_name", "location")


@query(
    "prt3_location_refresh",
    f"""WITH {LATEST}, {EXISTING}
    SELECT t.table_name, coalesce(n.location, t.location) AS location
    FROM (SELECT table_name, min(location) AS location FROM existing GROUP BY 1) t
    LEFT JOIN (SELECT object_name AS table_name, max(file_path) AS location FROM latest WHERE partition_value = 'none' GROUP BY 1) n
    USING (table_name)""",
    "object_data",
)
def location_refresh(lake):
    tables = existing(lake).groupBy("table_name").agg(F.min("location").alias("location"))
    fresh = latest(lake).where(F.col("partition_value") == pv.UNPARTITIONED_VALUE).groupBy(
        F.col("object_name").alias("table_name")
    ).agg(F.max("file_path").alias("location"))
    return ops.repointed_tables(tables, fresh)


@query(
    "prt4_selected_partitions",
    f"""WITH {LATEST}, {EXPANDED},
    ruled AS (SELECT *, CASE WHEN wf_type = 1 AND partition_key <> 'partition' THEN 'latest' WHEN wf_type = 1 THEN 'none'
       WHEN contains(partition_values, ':') THEN 'sub-partitions' ELSE 'values' END AS rule FROM notifications),
    newest AS (SELECT {KEY}, max(partition_value) AS partition_value FROM latest WHERE partition_value <= '2001-06-02' GROUP BY ALL)
    SELECT r.id, rule, l.object_name, l.file_path FROM ruled r JOIN (SELECT DISTINCT * FROM expanded) e USING (id) JOIN latest l
      ON l.object_name = r.object_name AND l.partition_value = e.wanted_value WHERE rule = 'values'
    UNION ALL SELECT r.id, rule, l.object_name, l.file_path FROM ruled r JOIN newest w USING ({KEY}) JOIN latest l
      ON l.object_name = w.object_name AND l.partition_value = w.partition_value WHERE rule = 'latest'
    UNION ALL SELECT r.id, rule, l.object_name, l.file_path FROM ruled r JOIN latest l ON l.object_name = r.object_name
      AND l.partition_value = split_part(r.partition_values, ':', 1) AND l.sub_value = split_part(r.partition_values, ':', 2)
      WHERE rule = 'sub-partitions'
    UNION ALL SELECT r.id, rule, l.object_name, l.file_path FROM ruled r JOIN latest l ON l.object_name = r.object_name
      AND l.partition_value = 'none' WHERE rule = 'none'""",
    "object_data notifications",
)
def selected_partitions(lake):
    # Both are tables in a lake; as projections they would be worked out anew for each rule.
    found = ops.selected_partitions(
        stable(lake.notifications), stable(latest(lake)), F.lit(AS_OF_DATE).cast("date")
    )
    return found.select("id", "rule", "object_name", "file_path")


@query(
    "prt5_existing_partitions",
    f"""WITH {EXISTING} SELECT table_name, part_name FROM existing e WHERE EXISTS (SELECT 1 FROM notifications n
      WHERE n.object_name = e.table_name AND (concat('tdate=', strftime(n.date_created, '%Y-%m-%d')) = e.part_name
      OR starts_with(e.part_name, concat('tdate=', strftime(n.date_created, '%Y-%m-%d'), '/'))))""",
    "object_data notifications",
)
def existing_partitions(lake):
    specs = lake.notifications.select(
        F.col("object_name").alias("table_name"),
        F.concat(F.lit("tdate="), F.date_format("date_created", "yyyy-MM-dd")).alias("spec"),
    )
    return ops.existing_partitions(existing(lake), specs).select("table_name", "part_name")


@query(
    "prt6_partition_diff",
    f"""WITH {LATEST}, {EXISTING}, {FRESH}
    SELECT coalesce(f.table_name, e.table_name) AS table_name, coalesce(f.part_name, e.part_name) AS part_name,
      CASE WHEN e.part_name IS NULL THEN 'add' WHEN f.part_name IS NULL THEN 'unregistered'
           WHEN e.location <> f.location THEN 'move' ELSE 'same' END AS change
    FROM fresh f FULL JOIN existing e ON e.table_name = f.table_name AND e.part_name = f.part_name""",
    "object_data",
)
def partition_diff(lake):
    diff = ops.partition_diff(named(latest(lake)), existing(lake))
    return diff.select("table_name", "part_name", "change")


@query(
    "prt9_stats_requests",
    f"""WITH {EXPANDED}
    SELECT n.object_name, 5 AS wf_type, 'SUBMITTED_BY_JOB_PROCESSOR' AS execution_id,
      CASE WHEN contains(n.partition_values, ':') THEN 'tdate,region' ELSE n.partition_key END AS partition_key,
      CASE WHEN contains(n.partition_values, ':') THEN replace(n.partition_values, ':', ',')
           WHEN n.wf_type = 1 AND n.partition_key <> 'partition' AND NOT contains(n.partition_values, ',') AND NOT contains(n.partition_values, '__') THEN ''
           ELSE wanted_value END AS partition_values
    FROM notifications n JOIN expanded USING (id)""",
    "notifications",
)
def stats_requests(lake):
    keys = F.array(F.lit("tdate"), F.lit("region"))
    pairs = pv.sub_partition_map(keys, pv.sub_values(F.col("partition_values")))
    items = lake.notifications.withColumn("key_values", pairs)
    return ops.stats_requests(items).select(
        "object_name", "wf_type", "execution_id", "partition_key", "partition_values"
    )


@query(
    "prt10_full_stats_requests",
    """SELECT id, concat('`', replace(partition_key, ',', '`,`'), '`') AS partition_key, '' AS partition_values,
      5 AS wf_type FROM notifications""",
    "notifications",
)
def full_stats_requests(lake):
    items = lake.notifications.withColumn("partition_names", F.split("partition_key", ","))
    made = ops.full_stats_requests(items.withColumn("object_name", F.col("id")))
    return made.select(
        F.col("object_name").alias("id"), "partition_key", "partition_values", "wf_type"
    )


@query(
    "prt11_manual_back_loads",
    f"""SELECT a.name AS notification_name, CASE kind WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN a.v IS NULL THEN 8 ELSE 0 END END AS wf_type,
      CASE WHEN kind = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'none' ELSE 'tdate' END WHEN a.v IS NULL THEN '' ELSE 'tdate' END AS partition_key,
      CASE WHEN kind = 0 THEN '{AS_OF_DATE}' WHEN a.v IS NULL THEN '' ELSE a.v END AS partition_values
    FROM (SELECT concat('N', cast(l_suppkey AS varchar)) AS name, CASE WHEN l_tax > 0.04 THEN strftime(l_shipdate, '%Y-%m-%d') END AS v FROM lineitem
      UNION ALL SELECT concat('N', cast(l_suppkey + 1 AS varchar)), CASE WHEN l_tax > 0.04 THEN strftime(l_shipdate, '%Y-%m-%d') END FROM lineitem) a
    JOIN (SELECT *, s_suppkey % 3 AS kind FROM supplier) r ON a.name = concat('N', cast(s_suppkey AS varchar)) WHERE kind < 2""",
)
def manual_back_loads(lake):
    day = F.when(F.col("l_tax") > 0.04, F.date_format("l_shipdate", "yyyy-MM-dd"))
    lists = lake.lineitem.select(
        F.concat(F.lit("N"), "l_suppkey", F.lit(",N"), F.col("l_suppkey") + 1).alias("names"),
        day.alias("partition_value"),
    )
    kind = F.col("s_suppkey") % 3
    registrations = lake.supplier.select(
        F.concat(F.lit("N"), "s_suppkey").alias("notification_name"),
        *[F.lit("x").alias(c) for c in OBJECT_KEY],
        F.when(kind == 0, workflow.SINGLETON_JOB).when(kind == 1, workflow.MANAGED_JOB)
        .otherwise(workflow.MAIL_ONLY_JOB).alias("job_name"),
        F.when((kind != 0) | (F.col("s_suppkey") % 2 == 1), "tdate").alias("partition_key"),
        F.lit("").alias("correlation_data"),
    )
    made = ops.manual_back_loads(lists, registrations, F.lit(AS_OF_DATE).cast("date"))
    return made.select("notification_name", "wf_type", "partition_key", "partition_values")


# Set operations ------------------------------------------------------------


@query(
    "set1_intersection",
    f"WITH {LATEST}, {EXPANDED} SELECT DISTINCT partition_value FROM latest INTERSECT SELECT wanted_value FROM expanded",
    "object_data notifications",
)
def intersection(lake):
    wanted = ops.requested_partitions(lake.notifications)
    return latest(lake).select("partition_value").intersect(wanted.select("wanted_value"))


@query(
    "set2_difference",
    f"WITH {LATEST}, {EXPANDED} SELECT DISTINCT partition_value FROM latest EXCEPT SELECT wanted_value FROM expanded",
    "object_data notifications",
)
def difference(lake):
    wanted = ops.requested_partitions(lake.notifications).select(F.col("wanted_value").alias("partition_value"))
    return latest(lake).select("partition_value").distinct().join(wanted, "partition_value", "left_anti")


@query(
    "set3_union",
    f"WITH {LATEST}, {EXPANDED} SELECT partition_value FROM latest UNION SELECT wanted_value FROM expanded",
    "object_data notifications",
)
def union(lake):
    wanted = ops.requested_partitions(lake.notifications).select("wanted_value")
    return latest(lake).select("partition_value").union(wanted).distinct()
