"""Whole flows: what a load does, and the work tables after a round."""

from __future__ import annotations

from pyspark.sql import functions as F

from lake_queries.evolution import SIDES
from lake_queries.partitions import LATEST, latest
from lake_queries.registry import query
from lake_queries.scalars import EXPANDED, LATE, ORIGINAL, clean
from lake_queries.tables import AS_OF_DATE
from quayside.operators import work
from quayside.plans.load import load, named_items, schema_statements
from quayside.plans.round import close_round
from quayside.session import stable

TABLE_NAME = f"""regexp_replace(concat(coalesce({ORIGINAL}, {LATE}, object_name), '_', usage_code, '_', file_type), '[. -]', '_', 'g')"""


def loaded(lake, columns=None):
    """What a load plans from without registered data: items, known tables, old and new columns."""
    items = work.with_attempts(lake.notifications.where("wf_type in (0, 1)"), lake.processing_log)
    full = F.translate(F.concat_ws("_", "object_name", "usage_code", "file_type"), ". -", "___")
    # Columns of table tN belong to object OBJ-N.
    owners = lake.date_keyed.select(
        F.replace("object_name", F.lit("OBJ-"), F.lit("t")).alias("table_name"), full.alias("_full")
    )

    def owned(columns):
        joined = columns.join(owners, "table_name").drop("table_name")
        return joined.withColumnRenamed("_full", "table_name")

    new_columns = lake.new_columns if columns is None else columns
    return items, owners.select(F.col("_full").alias("table_name")), owned(lake.old_columns), owned(new_columns)


def planned(lake, columns=None):
    items, *tables = loaded(lake, columns)
    return load(items, stable(latest(lake)), *tables, F.lit(AS_OF_DATE).cast("date"))


PARTITION_CTES = f"""{LATEST}, {EXPANDED}, i AS (SELECT *, {TABLE_NAME} AS table_name FROM notifications WHERE wf_type IN (0, 1)),
    known AS (SELECT regexp_replace(concat(object_name, '_', usage_code, '_', file_type), '[. -]', '_', 'g') AS table_name FROM date_keyed),
    newest AS (SELECT object_name, max(partition_value) AS partition_value FROM latest WHERE partition_value <= '2001-06-02' GROUP BY ALL),
    rows AS (
      SELECT DISTINCT i.id, table_name, partition_key, l.partition_value, l.sub_value, l.file_path FROM i JOIN expanded e USING (id) JOIN latest l
        ON l.object_name = i.object_name AND l.partition_value = e.wanted_value WHERE NOT contains(i.partition_values, ':') AND wf_type = 0
      UNION ALL SELECT i.id, table_name, partition_key, l.partition_value, l.sub_value, l.file_path FROM i JOIN newest w USING (object_name) JOIN latest l
        ON l.object_name = w.object_name AND l.partition_value = w.partition_value WHERE wf_type = 1 AND partition_key <> 'partition'
      UNION ALL SELECT i.id, table_name, partition_key, l.partition_value, l.sub_value, l.file_path FROM i JOIN latest l ON l.object_name = i.object_name
        AND l.partition_value = split_part(i.partition_values, ':', 1) AND l.sub_value = split_part(i.partition_values, ':', 2)
        WHERE contains(i.partition_values, ':') AND wf_type = 0)"""
PARTITION_STATEMENTS = """SELECT id, 3 AS step, a AS ordinal, concat('ALTER TABLE `', table_name, CASE a WHEN 0 THEN '` DROP IF EXISTS' ELSE '` ADD IF NOT EXISTS' END,
      ' PARTITION (TDATE=''', partition_value, '''', CASE WHEN sub_value IS NULL THEN '' ELSE concat(', region=''', sub_value, '''') END, ')',
      CASE a WHEN 0 THEN ';' ELSE concat(' LOCATION ''', file_path, ''';') END) AS statement FROM rows, (VALUES (0), (1)) acts(a)
    UNION ALL SELECT id, 2, 0, concat('alter table ', table_name, ' drop if exists partition (', partition_key, ' >''1970-01-01'');') FROM i
      WHERE wf_type = 1 AND partition_key <> 'partition' AND table_name IN (SELECT table_name FROM known)
    UNION ALL SELECT i.id, 3, 0, concat('alter table ', table_name, ' SET LOCATION ''', max(l.file_path), ''';') FROM i JOIN latest l
      ON l.object_name = i.object_name AND l.partition_value = 'none' WHERE wf_type = 1 AND partition_key = 'partition' GROUP BY i.id, table_name"""


@query(
    "plan_load_partition_statements",
    f"WITH {PARTITION_CTES} {PARTITION_STATEMENTS}",
    "object_data notifications date_keyed",
)
def load_partition_statements(lake):
    return planned(lake).statements.where("step >= 2")


SCHEMA_CTES = f"""{SIDES}, s AS (SELECT *, {TABLE_NAME} AS table_name, {clean('namespace')} AS db FROM notifications WHERE wf_type IN (0, 1)),
    m AS (SELECT replace(object_name, 'OBJ-', 't') AS t, {clean("concat(object_name, '_', usage_code, '_', file_type)")} AS table_name FROM date_keyed),
    c AS (SELECT m.table_name, x.* EXCLUDE (table_name) FROM changes x JOIN m ON m.t = x.table_name WHERE change <> 'dropped'),
    whole AS (SELECT m.table_name, string_agg(concat('`', name, '` ', type), ', ' ORDER BY ordinal) AS cols
        FROM new_columns n JOIN m ON m.t = n.table_name WHERE NOT is_partition GROUP BY 1),
    j AS (SELECT s.id, s.table_name, s.file_type, s.wf_type = 1 AND s.partition_key = 'partition' AS anew FROM s JOIN m ON m.table_name = s.table_name)"""
SCHEMA_STATEMENTS = """SELECT id, 0 AS step, 0 AS ordinal, concat('CREATE DATABASE IF NOT EXISTS ', db, ';') AS statement FROM s
    UNION ALL SELECT id, 0, 1, concat('use ', db, ';') FROM s
    UNION ALL SELECT j.id, 1, CASE change WHEN 'name' THEN 10000 ELSE 20000 END + ordinal, concat('Alter table ', table_name, ' change ', old_name, ' ', new_name, ' ', new_type, ' CASCADE;')
      FROM c JOIN j USING (table_name) WHERE NOT anew AND file_type = 'ORC' AND change IN ('name', 'type')
    UNION ALL SELECT j.id, 1, 30000 + min(ordinal), concat('Alter table ', table_name, ' add columns (', string_agg(concat(new_name, ' ', new_type), ',' ORDER BY ordinal), ') CASCADE;')
      FROM c JOIN j USING (table_name) WHERE NOT anew AND file_type = 'ORC' AND change = 'added' GROUP BY j.id, table_name
    UNION ALL SELECT j.id, 1, 10000, concat('ALTER TABLE `', table_name, '` REPLACE COLUMNS (', cols, ') CASCADE;') FROM whole JOIN j USING (table_name)
      WHERE NOT anew AND file_type <> 'ORC' AND table_name IN (SELECT table_name FROM c)
    UNION ALL SELECT j.id, 1, 0, concat('ALTER TABLE `', table_name, '` REPLACE COLUMNS (', cols, ');') FROM whole JOIN j USING (table_name) WHERE anew"""


@query(
    "plan_load_schema_statements",
    f"WITH {SCHEMA_CTES} {SCHEMA_STATEMENTS}",
    "notifications old_columns new_columns date_keyed",
)
def load_schema_statements(lake):
    items, existing, old_columns, new_columns = loaded(lake)
    return schema_statements(named_items(items, existing), old_columns, new_columns)


@query(
    "plan_load_all_statements",
    f"WITH {SCHEMA_CTES}, {PARTITION_CTES} SELECT * FROM ({SCHEMA_STATEMENTS}) UNION ALL SELECT * FROM ({PARTITION_STATEMENTS})",
    "notifications old_columns new_columns date_keyed object_data",
)
def load_all_statements(lake):
    """Databases, schema changes and partitions together, by item and step."""
    return planned(lake).statements


@query(
    "plan_load_left_out",
    f"""WITH {PARTITION_CTES}, numbered AS (SELECT id, table_name, object_name, partition_key, partition_values, wf_type,
        cast(replace(object_name, 'OBJ-', '') AS BIGINT) AS n FROM i)
    SELECT r.id, r.table_name, r.partition_value, coalesce(r.sub_value, '') AS sub_value,
      CASE WHEN n % 5 = 0 THEN 'no registered format' ELSE 'more levels than keys' END AS reason
    FROM rows r JOIN numbered USING (id) WHERE n % 5 = 0 OR (n % 2 = 1 AND r.sub_value IS NOT NULL)
    UNION ALL
    SELECT DISTINCT n.id, n.table_name, wanted_value, '', 'no registered data' FROM numbered n JOIN expanded e USING (id)
    WHERE wf_type = 0 AND NOT contains(n.partition_values, ':') AND NOT EXISTS (
      SELECT 1 FROM latest l WHERE l.object_name = n.object_name AND l.partition_value = e.wanted_value)
    UNION ALL
    SELECT n.id, n.table_name, n.partition_values, '', 'no registered data' FROM numbered n
    WHERE wf_type = 0 AND contains(n.partition_values, ':') AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.object_name = n.object_name
      AND l.partition_value = split_part(n.partition_values, ':', 1) AND l.sub_value = split_part(n.partition_values, ':', 2))
    UNION ALL
    SELECT n.id, n.table_name, 'none', '', 'no registered data' FROM numbered n WHERE wf_type = 1 AND partition_key = 'partition'
      AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.object_name = n.object_name AND l.partition_value = 'none')""",
    "object_data notifications",
)
def load_left_out(lake):
    """Partitions that get no statement, where some objects lack a format or a second key."""
    number = F.substring("table_name", 2, 20).cast("long")
    columns = lake.new_columns.where((number % 5 != 0) & ~((F.col("name") == "region") & (number % 2 == 1)))
    left = planned(lake, columns).left_out
    return left.withColumn("sub_value", F.coalesce(F.array_join("sub_partition_values", ":"), F.lit(""))).drop("sub_partition_values")


CLOSING = """closing AS (SELECT p.id AS log_id, notification_id AS id, end_time,
    CASE WHEN id % 10 < 4 THEN 'Y' ELSE 'N' END AS outcome FROM processing_log p WHERE success = 'P')"""


@query(
    "plan_round_of_work",
    f"""WITH {CLOSING}, last AS (SELECT id, max({{'e': end_time, 'l': log_id, 'o': outcome}}).o AS outcome FROM closing GROUP BY 1),
    judged AS (SELECT l.id, outcome, (SELECT count(*) FROM processing_log p WHERE p.notification_id = l.id) - 1 AS retries FROM last l),
    gone AS (SELECT id, outcome FROM judged WHERE outcome = 'Y' OR retries >= 4)
    SELECT n.id, CASE WHEN g.id IS NULL THEN 'kept' WHEN outcome = 'Y' THEN 'succeeded' ELSE 'exhausted' END AS state
    FROM notifications n LEFT JOIN gone g USING (id) UNION ALL SELECT id + 1000000000, 'kept' FROM notifications WHERE wf_type = 8""",
    "notifications processing_log",
)
def round_of_work(lake):
    closing = lake.processing_log.where("success = 'P'").select(
        F.col("id").alias("log_id"), F.col("notification_id").alias("id"), "end_time",
        F.when(F.col("id") % 10 < 4, "Y").otherwise("N").alias("outcome"),
    )
    added = lake.notifications.where("wf_type = 8").withColumn("id", F.col("id") + 1000000000)
    after = close_round(lake.notifications, lake.processing_log, closing, added, 5)
    gone = after.item_history.select("id").join(
        after.exhausted.select("id", F.lit(True).alias("_spent")), "id", "left"
    )
    return after.items.select("id", F.lit("kept").alias("state")).unionByName(
        gone.select("id", F.when(F.col("_spent"), "exhausted").otherwise("succeeded").alias("state"))
    )
