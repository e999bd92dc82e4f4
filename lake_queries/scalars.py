"""Scalar functions over the lake's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lake_queries.registry import query
from lake_queries.tables import AS_OF
from quayside.functions import ddl, directory, names, partitions, text, workflow

JSON = "CASE WHEN json_valid(correlation_data) THEN correlation_data ->> '$.businessObject.{}' END"
LATE, ORIGINAL = JSON.format("late_reporting_for"), JSON.format("original_object_name")


def clean(expression: str) -> str:
    return f"regexp_replace({expression}, '[. -]', '_', 'g')"


@query("scl1_database_name", f"SELECT id, {clean('namespace')} AS database_name FROM notifications", "notifications")
def database_name(lake):
    return lake.notifications.select("id", names.database_name(F.col("namespace")).alias("database_name"))


@query(
    "scl2_table_name",
    f"""SELECT id, {clean(f"concat(coalesce({ORIGINAL}, {LATE}, object_name), '_', usage_code, '_', file_type)")} AS table_name
    FROM notifications""",
    "notifications",
)
def table_name(lake):
    made = names.table_name(
        F.col("object_name"), F.col("usage_code"), F.col("file_type"), F.col("correlation_data")
    )
    return lake.notifications.select("id", made.alias("table_name"))


@query("scl3_actual_object_name", f"SELECT id, coalesce({LATE}, object_name) AS actual FROM notifications", "notifications")
def actual_object_name(lake):
    made = names.actual_object_name(F.col("object_name"), F.col("correlation_data"))
    return lake.notifications.select("id", made.alias("actual"))


@query(
    "scl4_storage_names",
    """SELECT id, coalesce(array_to_string(CASE WHEN json_valid(correlation_data) THEN
       cast(json_extract(correlation_data, '$.businessObject.storageNames') AS varchar[]) END, ','), '?') AS storages
    FROM notifications""",
    "notifications",
)
def storage_names(lake):
    return lake.notifications.select("id", names.storage_names(F.col("correlation_data")).alias("storages"))


@query(
    "scl5_collects_statistics",
    """SELECT id, coalesce(upper(CASE WHEN json_valid(correlation_data) THEN
       correlation_data ->> '$.processing.collectStatistics' END) <> 'NONE', true) AS collects FROM notifications""",
    "notifications",
)
def collects_statistics(lake):
    return lake.notifications.select("id", names.collects_statistics(F.col("correlation_data")).alias("collects"))


EXPANDED = """expanded AS (
  SELECT id, unnest(CASE
    WHEN contains(partition_values, '__') AND split_part(partition_values, '__', 2) < split_part(partition_values, '__', 1)
      THEN list_transform(generate_series(cast(split_part(partition_values, '__', 2) AS date),
           cast(split_part(partition_values, '__', 1) AS date), INTERVAL 1 DAY), lambda d: strftime(d, '%Y-%m-%d'))
    WHEN contains(partition_values, '__') THEN [split_part(partition_values, '__', 1)]
    WHEN contains(partition_values, ',') THEN string_split(partition_values, ',')
    ELSE [partition_values] END) AS wanted_value FROM notifications)"""


@query("scl6_partition_values", f"WITH {EXPANDED} SELECT * FROM expanded", "notifications")
def partition_values(lake):
    values = partitions.expanded_values(F.col("partition_values"))
    return lake.notifications.select("id", F.explode(values).alias("wanted_value"))


@query(
    "scl7_days_between",
    """SELECT l_orderkey, l_linenumber, l_partkey, count(day) AS days, strftime(min(day), '%Y-%m-%d') AS first_day,
       strftime(max(day), '%Y-%m-%d') AS last_day
    FROM (SELECT *, unnest(generate_series(o_orderdate, l_shipdate - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day
          FROM (SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate, l_shipdate
                FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate < l_shipdate)) GROUP BY 1, 2, 3""",
)
def days_between(lake):
    dated = lake.lineitem.join(lake.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = partitions.days_between(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))
    counted = dated.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.sum(F.size(days)).cast("long").alias("days"),
        F.min(F.get(days, 0)).cast("string").alias("first_day"),
        F.max(F.try_element_at(days, F.lit(-1))).cast("string").alias("last_day"),
    )
    return counted.where("days > 0")


@query(
    "scl8_sub_partitions",
    """SELECT id, split_part(partition_values, ':', 1) AS tdate, split_part(partition_values, ':', 2) AS region
    FROM notifications WHERE contains(partition_values, ':')""",
    "notifications",
)
def sub_partitions(lake):
    keys = F.array(F.lit("tdate"), F.lit("region"), F.lit("kind"))
    pairs = partitions.sub_partition_map(keys, partitions.sub_values(F.col("partition_values")))
    return lake.notifications.where(F.col("partition_values").contains(":")).select(
        "id", pairs["tdate"].alias("tdate"), pairs["region"].alias("region")
    )


SPEC = """CASE WHEN v = '' THEN concat('`', k, '`') WHEN lower(k) = 'partition' THEN 'none'
  WHEN contains(k, ',') AND contains(v, ',') THEN array_to_string(list_transform(
    list_zip(string_split(k, ','), string_split(v, ',')), lambda p: concat('`', p[1], '`=''', p[2], '''')), ',')
  ELSE concat('`', k, '`=''', v, '''') END"""


@query(
    "scl9_stats_partition_spec",
    f"""SELECT id, {SPEC} AS spec FROM (SELECT id, partition_key AS k,
        CASE WHEN wf_type = 8 THEN '' ELSE partition_values END AS v FROM notifications)""",
    "notifications",
)
def stats_partition_spec(lake):
    value = F.when(F.col("wf_type") == 8, F.lit("")).otherwise(F.col("partition_values"))
    return lake.notifications.select(
        "id", partitions.stats_partition_spec(F.col("partition_key"), value).alias("spec")
    )


@query(
    "scl10_stats_keys_and_values",
    """SELECT id, CASE WHEN sub THEN 'tdate,region' ELSE partition_key END AS stats_keys,
       CASE WHEN sub THEN replace(partition_values, ':', ',')
            WHEN wf_type = 1 AND lower(partition_key) <> 'partition' THEN '' ELSE partition_values END AS stats_values
    FROM (SELECT *, contains(partition_values, ':') AS sub FROM notifications)""",
    "notifications",
)
def stats_keys_and_values(lake):
    keys = F.array(F.lit("tdate"), F.lit("region"))
    pairs = partitions.sub_partition_map(keys, partitions.sub_values(F.col("partition_values")))
    return lake.notifications.select(
        "id",
        partitions.stats_keys(pairs, F.col("partition_key")).alias("stats_keys"),
        partitions.stats_values(
            pairs, F.col("wf_type"), F.col("partition_key"), F.col("partition_values")
        ).alias("stats_values"),
    )


SPEC_TEXT = "concat('(`TDate`=''', cast(cast(l_shipdate AS date) AS varchar), ''', `Region`=''r', cast(l_linenumber AS varchar), ''')')"


def spec_text():
    return F.concat(
        F.lit("(`TDate`='"), F.col("l_shipdate").cast("date").cast("string"),
        F.lit("', `Region`='r"), F.col("l_linenumber").cast("string"), F.lit("')"),
    )


@query(
    "scl11_canonical_partition",
    """SELECT DISTINCT l_suppkey, concat('tdate=', cast(cast(l_shipdate AS date) AS varchar), '/region=r', cast(l_linenumber AS varchar)) AS part_name
    FROM lineitem""",
)
def canonical_partition(lake):
    return lake.lineitem.select(
        "l_suppkey", partitions.canonical_partition(spec_text()).alias("part_name")
    ).distinct()


@query(
    "scl12_partition_statements",
    f"""SELECT DISTINCT concat('ALTER TABLE `t', cast(l_suppkey AS varchar), '` ADD IF NOT EXISTS PARTITION ', {SPEC_TEXT},
          ' LOCATION ''s3://x/', cast(l_orderkey AS varchar), ''';') AS added,
       concat('ALTER TABLE `t', cast(l_suppkey AS varchar), '` PARTITION ', {SPEC_TEXT},
          ' SET LOCATION ''s3://x/', cast(l_orderkey AS varchar), ''';') AS moved FROM lineitem""",
)
def partition_statements(lake):
    table = F.concat(F.lit("t"), F.col("l_suppkey").cast("string"))
    location = F.concat(F.lit("s3://x/"), F.col("l_orderkey").cast("string"))
    return lake.lineitem.select(
        partitions.add_partition_text(table, spec_text(), location).alias("added"),
        partitions.move_partition_text(table, spec_text(), location).alias("moved"),
    ).distinct()


# Column types spelled in several ways, from parts.
TYPE = """CASE p_partkey % 6 WHEN 0 THEN 'DECIMAL' WHEN 1 THEN concat('decimal(', cast(p_size % 20 + 1 AS string), ')')
  WHEN 2 THEN concat('DECIMAL( ', cast(p_size % 20 + 1 AS string), ' , ', cast(p_size % 4 AS string), ' )')
  WHEN 3 THEN 'BIGINT' WHEN 4 THEN 'bigint' ELSE concat('varchar(', cast(p_size AS string), ')') END"""
PARSED = r"""parsed AS (SELECT p_partkey, p_brand, t, upper(t) LIKE 'DECIMAL%' AS is_decimal,
  coalesce(try_cast(nullif(regexp_extract(t, '(?i)^decimal\(\s*(\d+)', 1), '') AS int), 10) AS p,
  coalesce(try_cast(nullif(regexp_extract(t, '(?i)^decimal\(\s*\d+\s*,\s*(\d+)', 1), '') AS int), 0) AS s
  FROM (SELECT *, {} AS t FROM part))""".format(TYPE)


def typed_parts(lake):
    return lake.part.select("p_partkey", "p_brand", F.expr(TYPE).alias("t"))


@query("scl13_decimal_type", f"WITH {PARSED} SELECT p_partkey, p, s FROM parsed WHERE is_decimal")
def decimal_type(lake):
    t = F.col("t")
    return typed_parts(lake).where(F.upper(t).startswith("DECIMAL")).select(
        "p_partkey", ddl.decimal_precision(t).alias("p"), ddl.decimal_scale(t).alias("s")
    )


@query(
    "scl14_same_type",
    f"""WITH {PARSED}
    SELECT a.p_partkey, upper(a.t) = upper(b.t) OR (a.is_decimal AND b.is_decimal AND a.p = b.p AND a.s = b.s) AS same
    FROM parsed a JOIN parsed b ON b.p_partkey = a.p_partkey + 1""",
)
def same_type(lake):
    left = typed_parts(lake)
    right = left.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"))
    return left.join(right, "p_partkey").select(
        "p_partkey", ddl.same_type(F.col("t"), F.col("u")).alias("same")
    )


@query(
    "scl15_same_delimiter",
    r"""SELECT l_orderkey, l_linenumber, l_partkey, max(CASE
        WHEN a = b THEN 1 WHEN code_a IS NOT NULL AND code_b IS NOT NULL AND code_a = code_b THEN 1 ELSE 0 END) AS same
    FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN l_quantity::int WHEN 1 THEN l_quantity::int END AS code_a,
                 CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 50 END AS code_b,
                 CASE l_linenumber % 3 WHEN 0 THEN concat('\u', printf('%04x', l_quantity::int)) WHEN 1 THEN concat('\', printf('%03d', l_quantity::int)) ELSE ',' END AS a,
                 CASE WHEN l_linenumber % 2 = 0 THEN concat('\', printf('%03d', (l_suppkey % 50)::int)) ELSE ',' END AS b
          FROM lineitem) GROUP BY 1, 2, 3""",
)
def same_delimiter(lake):
    quantity, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    left = (
        F.when(line % 3 == 0, F.format_string("\\u%04x", quantity))
        .when(line % 3 == 1, F.format_string("\\%03d", quantity))
        .otherwise(",")
    )
    right = F.when(line % 2 == 0, F.format_string("\\%03d", F.col("l_suppkey") % 50)).otherwise(",")
    return lake.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.max(ddl.same_character(left, right).cast("int")).alias("same")
    )


def definitions(lake):
    """A table definition per part: both partition layouts, three row formats."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    partition_list = F.when(key % 2 == 0, "`tdate` date, `region` string").otherwise(
        "\n  `tdate` date,\n  `kind` int"
    )
    row_format = (
        F.when(key % 3 == 0, r"DELIMITED FIELDS TERMINATED BY '|' ESCAPED BY '\' NULL DEFINED AS 'N'")
        .when(
            key % 3 == 1,
            r"SERDE 'x' WITH SERDEPROPERTIES ('field.delim'='\001', 'escape.delim'='~', 'serialization.null.format'='null')",
        )
        .otherwise("SERDE 'y'")
    )
    text_of = F.concat(
        F.lit("CREATE EXTERNAL TABLE `"), "p_brand", F.lit("` (\n  `id` bigint,\n  `"), "p_type",
        F.lit("_price` "), "t", F.lit(" COMMENT 'the price',\n  `Amount` DECIMAL (18,"),
        (F.col("p_size") % 9).cast("string"), F.lit("),\n  `name` varchar("), size,
        F.lit("))\nPARTITIONED BY ("), partition_list, F.lit(")\nROW FORMAT "), row_format,
        F.lit("\nSTORED AS ORC"),
    )
    return lake.part.withColumn("t", F.expr(TYPE)).withColumn("ddl", text_of)


@query(
    "scl16_columns_of_definition",
    f"""SELECT p_partkey, c.ordinal, c.name, c.type FROM (SELECT p_partkey, unnest([
      {{'ordinal': 0, 'name': 'id', 'type': 'bigint'}},
      {{'ordinal': 1, 'name': concat(p_type, '_price'), 'type': CASE WHEN position(' ' IN t) > 0 THEN
           concat(split_part(t, ' ', 1), split_part(t, ' ', 2)) ELSE t END}},
      {{'ordinal': 2, 'name': 'Amount', 'type': concat('DECIMAL(18,', cast(p_size % 9 AS varchar), ')')}},
      {{'ordinal': 3, 'name': 'name', 'type': concat('varchar(', cast(p_size AS varchar), ')')}}]) AS c FROM (SELECT *, {TYPE} AS t FROM part))""",
)
def columns_of_definition(lake):
    return definitions(lake).select("p_partkey", F.inline(ddl.table_columns(F.col("ddl"))))


@query(
    "scl17_partition_columns_of_definition",
    """SELECT p_partkey, c.ordinal, c.name, c.type FROM (SELECT p_partkey, unnest([
      {'ordinal': 0, 'name': 'tdate', 'type': 'date'},
      {'ordinal': 1, 'name': CASE p_partkey % 2 WHEN 0 THEN 'region' ELSE 'kind' END,
       'type': CASE p_partkey % 2 WHEN 0 THEN 'string' ELSE 'int' END}]) AS c FROM part)""",
)
def partition_columns_of_definition(lake):
    return definitions(lake).select("p_partkey", F.inline(ddl.partition_columns(F.col("ddl"))))


@query(
    "scl18_format_of_definition",
    r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '|' WHEN 1 THEN '\001' ELSE '' END AS delimiter,
      CASE p_partkey % 3 WHEN 0 THEN '\' WHEN 1 THEN '~' ELSE '' END AS escape,
      CASE p_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'null' ELSE '' END AS null_token, true AS parse_ok FROM part""",
)
def format_of_definition(lake):
    text_of = F.col("ddl")
    return definitions(lake).select(
        "p_partkey",
        ddl.field_delimiter(text_of).alias("delimiter"),
        ddl.escape_character(text_of).alias("escape"),
        ddl.null_token(text_of).alias("null_token"),
        ddl.parses(text_of).alias("parse_ok"),
    )


@query(
    "scl19_member_user",
    "SELECT c_custkey, trim(c_name) AS member FROM customer",
)
def member_user(lake):
    dn = F.concat(F.lit("cn= "), F.col("c_name"), F.lit(" ,ou=People,ou="), F.col("c_mktsegment"))
    return lake.customer.select("c_custkey", directory.member_user(dn).alias("member"))


@query(
    "scl20_header_roles",
    """SELECT c_custkey, array_to_string(regexp_extract_all(concat('cn=role_', c_mktsegment, ',ou=Groups,cn=role_',
       cast(c_nationkey AS varchar)), 'cn=(.+?)(,|$)', 1), '|') AS roles FROM customer""",
)
def header_roles(lake):
    header = F.concat(
        F.lit("cn=role_"), F.col("c_mktsegment"), F.lit(",ou=Groups,cn=role_"), F.col("c_nationkey").cast("string")
    )
    return lake.customer.select("c_custkey", F.array_join(directory.header_roles(header), "|").alias("roles"))


@query(
    "scl21_date_key",
    """SELECT id, lower(k) = 'tdate' AND id % 3 <> 0 AS is_date
    FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'TDATE' ELSE partition_key END AS k FROM notifications)""",
    "notifications",
)
def date_key(lake):
    schema = F.array(
        F.struct(F.lit("region").alias("name"), F.lit("string").alias("type")),
        F.struct(
            F.lit("tdate").alias("name"),
            F.when(F.col("id") % 3 == 0, "string").otherwise("DATE").alias("type"),
        ),
    )
    key = F.when(F.col("id") % 4 == 0, "TDATE").otherwise(F.col("partition_key"))
    return lake.notifications.select("id", partitions.is_date_key(schema, key).alias("is_date"))


@query(
    "scl22_workflow_class",
    """SELECT id, CASE WHEN wf_type = 0 THEN 'managed' WHEN wf_type = 5 THEN 'stats'
      WHEN wf_type = 1 AND partition_key = 'partition' THEN 'unpartitioned singleton'
      WHEN wf_type = 1 THEN 'partitioned singleton' ELSE 'other' END AS class FROM notifications""",
    "notifications",
)
def workflow_class(lake):
    made = workflow.classification(F.col("wf_type"), F.col("partition_key"))
    return lake.notifications.select("id", made.alias("class"))


@query(
    "scl23_processor_and_action",
    """SELECT id, CASE WHEN wf_type IN (0, 1) THEN 'add partition' WHEN wf_type = 5 THEN 'gather stats'
      WHEN wf_type = 7 THEN 'drop table' WHEN wf_type = 8 THEN 'back load' ELSE 'none' END AS processor,
      CASE wf_type WHEN 5 THEN 'Gather Stats' WHEN 7 THEN 'Drop Table' ELSE 'Add Partition' END AS action FROM notifications""",
    "notifications",
)
def processor_and_action(lake):
    wf = F.col("wf_type")
    return lake.notifications.select(
        "id",
        F.coalesce(workflow.processor(wf), F.lit("none")).alias("processor"),
        workflow.action_label(wf).alias("action"),
    )


@query(
    "scl24_workflow_of_job",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 0
      WHEN o_orderstatus = 'O' THEN 8 ELSE -1 END AS wf_type FROM orders""",
)
def workflow_of_job(lake):
    status = F.col("o_orderstatus")
    job = (
        F.when(status == "F", workflow.SINGLETON_JOB)
        .when(status == "O", workflow.MANAGED_JOB)
        .otherwise(workflow.MAIL_ONLY_JOB)
    )
    value = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("date").cast("string"))
    code = workflow.code_for_job(job, value)
    return lake.orders.select("o_orderkey", F.coalesce(code, F.lit(-1)).alias("wf_type"))


@query(
    "scl25_age_check",
    f"""SELECT id, trunc((epoch(TIMESTAMP '{AS_OF}') - epoch(date_created)) / 3600.0)::BIGINT AS hours,
      trunc((epoch(TIMESTAMP '{AS_OF}') - epoch(date_created)) / 3600.0)::BIGINT > 20000 AS aged FROM notifications""",
    "notifications",
)
def age_check(lake):
    as_of = F.lit(AS_OF).cast("timestamp")
    return lake.notifications.select(
        "id",
        workflow.age_in_hours(F.col("date_created"), as_of).alias("hours"),
        workflow.older_than(F.col("date_created"), as_of, 20000).alias("aged"),
    )


@query(
    "scl26_user_schema",
    """SELECT c_custkey, concat('user_', lower(c_name)) AS schema_name,
      concat('s3://home/', 'user_', lower(c_name), '.db') AS location, concat('user_', c_name) AS plain FROM customer""",
)
def user_schema(lake):
    name = F.col("c_name")
    return lake.customer.select(
        "c_custkey",
        names.user_schema(name).alias("schema_name"),
        names.user_schema_location("s3://home", name).alias("location"),
        names.user_schema(name, fold_case=False).alias("plain"),
    )


@query(
    "scl27_storage_path",
    """SELECT file_path, concat(namespace, '/prov/', usage_code, '/', file_type, '/', object_name, '/schm-v', cast(format_version AS varchar),
      '/data-v', cast(data_version AS varchar), '/tdate=', partition_value,
      CASE WHEN sub_value IS NULL THEN '' ELSE concat('/region=', sub_value) END) AS path FROM object_data""",
    "object_data",
)
def storage_path(lake):
    subs = F.map_from_arrays(
        F.when(F.col("sub_partition_values").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("region"))),
        F.coalesce("sub_partition_values", F.array().cast("array<string>")),
    )
    path = names.storage_path(
        F.col("namespace"), F.lit("prov"), F.col("usage_code"), F.col("file_type"), F.col("object_name"),
        F.col("format_version"), F.col("data_version"), F.lit("tdate"), F.col("partition_value"), subs,
    )
    return lake.registered_data.select("file_path", path.alias("path"))


@query(
    "scl28_notification_names",
    f"""SELECT id, concat({clean("concat(namespace, '_', object_name, '_', usage_code, '_', file_type)")}, e.suffix) AS name, e.status
    FROM notifications, (VALUES ('_ARCHIVE', 'ARCHIVING'), ('_RESTORE', 'RESTORED'), ('_EXPIRE', 'EXPIRING')) e(suffix, status)""",
    "notifications",
)
def notification_names(lake):
    name = names.notification_name(*[F.col(c) for c in names.OBJECT_KEY])
    return lake.notifications.select("id", F.inline(names.storage_notifications(name)))


@query(
    "scl29_failure_text",
    """SELECT n.id, concat(CASE wf_type WHEN 5 THEN 'Gather Stats' WHEN 7 THEN 'Drop Table' ELSE 'Add Partition' END,
        ' Failed After ', cast(id % 5 + 1 AS varchar), ' Retries for ', namespace, '-', object_name, '-', usage_code, '-', file_type, '-',
        CASE WHEN contains(partition_values, ',') THEN concat(partition_values, '...') ELSE partition_values END) AS subject,
      concat('Cluster ID = ', cluster_name, ', Execution ID = ', execution_id, ' ', chr(10), ' ',
        CASE WHEN contains(partition_values, ',') THEN concat('Partition Values: ', partition_values, ' ', chr(10), chr(10), ' boom') ELSE 'boom' END) AS body
    FROM notifications n""",
    "notifications",
)
def failure_text(lake):
    subject = text.failure_subject(F.col("wf_type"), F.col("id") % 5 + 1)
    full = text.full_subject(
        subject, *[F.col(c) for c in names.OBJECT_KEY], partition_values=F.col("partition_values")
    )
    body = text.failure_body(
        F.col("cluster_name"), F.col("execution_id"), F.col("partition_values"), F.lit("boom")
    )
    return lake.notifications.select("id", full.alias("subject"), body.alias("body"))


@query(
    "snk8_rendered_rows",
    """SELECT concat_ws('|', cast(id AS varchar), coalesce(correlation_data, 'null'), coalesce(partition_values, 'null'),
      cast(wf_type AS varchar), coalesce(strftime(date_created, '%Y-%m-%d'), 'null')) AS line FROM notifications""",
    "notifications",
)
def rendered_rows(lake):
    shown = lake.notifications.select(
        "id", "correlation_data", "partition_values", "wf_type", F.col("date_created").cast("date")
    )
    return text.rendered(shown, "|")



