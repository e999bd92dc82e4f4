"""Schema changes, plans and reports; column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lake_queries.registry import query
from quayside.operators import evolution, profile, statistics
from quayside.session import work_dir

SIDES = """sides AS (SELECT coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.is_partition, n.is_partition) AS is_partition,
    coalesce(o.ordinal, n.ordinal) AS ordinal, o.name AS old_name, o.type AS old_type, n.name AS new_name, n.type AS new_type
  FROM old_columns o FULL JOIN new_columns n ON o.table_name = n.table_name AND o.is_partition = n.is_partition AND o.ordinal = n.ordinal),
same AS (SELECT *, lower(old_name) = lower(new_name) AS same_name, upper(old_type) = upper(new_type) OR (
    upper(old_type) LIKE 'DECIMAL%' AND upper(new_type) LIKE 'DECIMAL%'
    AND CASE WHEN contains(old_type, '(') THEN regexp_extract(old_type, '\\((\\d+)', 1) ELSE '10' END
      = CASE WHEN contains(new_type, '(') THEN regexp_extract(new_type, '\\((\\d+)', 1) ELSE '10' END
    AND CASE WHEN contains(old_type, ',') THEN regexp_extract(old_type, ',(\\d+)', 1) ELSE '0' END
      = CASE WHEN contains(new_type, ',') THEN regexp_extract(new_type, ',(\\d+)', 1) ELSE '0' END) AS same_type FROM sides),
changes AS (SELECT * FROM (SELECT *, CASE WHEN old_name IS NULL THEN 'added' WHEN new_name IS NULL THEN 'dropped'
    WHEN NOT same_name THEN 'name' WHEN NOT same_type THEN 'type' END AS change FROM same WHERE NOT is_partition) WHERE change IS NOT NULL),
moved AS (SELECT table_name, bool_or(NOT coalesce(same_name AND same_type, false)) AS partition_changed FROM same WHERE is_partition GROUP BY 1)"""
BOTH = "old_columns new_columns"


def changes(lake, **options):
    return evolution.column_changes(lake.old_columns, lake.new_columns, **options)


def flags(lake):
    return evolution.partition_changes(lake.old_columns, lake.new_columns)


@query(
    "sch1_column_changes",
    f"""WITH {SIDES} SELECT table_name, ordinal, coalesce(old_name, '') AS old_name, coalesce(new_name, '') AS new_name, change
    FROM changes WHERE change <> 'dropped'""",
    BOTH,
)
def column_changes(lake):
    return changes(lake).select(
        "table_name", "ordinal",
        F.coalesce("old_name", F.lit("")).alias("old_name"),
        F.coalesce("new_name", F.lit("")).alias("new_name"), "change",
    )


@query(
    "sch1_changes_with_dropped",
    f"WITH {SIDES} SELECT change, table_name, ordinal, old_name, old_type, new_name, new_type FROM changes",
    BOTH,
)
def changes_with_dropped(lake):
    return changes(lake, report_dropped=True)


@query("sch2_partition_changes", f"WITH {SIDES} SELECT * FROM moved", BOTH)
def partition_changes(lake):
    return flags(lake)


@query(
    "sch3_change_flags",
    f"""WITH {SIDES}, c AS (SELECT DISTINCT table_name FROM changes WHERE change <> 'dropped')
    SELECT t.table_name, c.table_name IS NOT NULL AS column_changed, coalesce(partition_changed, false) AS partition_changed,
      c.table_name IS NOT NULL OR coalesce(partition_changed, false) AS changed
    FROM evolving t LEFT JOIN c USING (table_name) LEFT JOIN moved USING (table_name)""",
    f"{BOTH} evolving",
)
def change_flags(lake):
    return evolution.change_flags(lake.evolving, changes(lake), flags(lake))


BROKEN = "format_version = 4"


@query(
    "sch4_change_plan",
    f"""WITH {SIDES}, t AS (SELECT *, CASE WHEN wf_type = 1 AND partition_key = 'partition' THEN 'whole' WHEN {BROKEN} THEN CASE file_type WHEN 'ORC' THEN 'lost' ELSE 'broken' END
      WHEN file_type = 'ORC' THEN 'columns' ELSE 'text' END AS kind FROM evolving),
    c AS (SELECT * FROM changes WHERE change <> 'dropped'),
    whole AS (SELECT table_name, string_agg(concat('`', name, '` ', type), ', ' ORDER BY ordinal) AS cols FROM new_columns WHERE NOT is_partition GROUP BY 1)
    SELECT table_name, CASE change WHEN 'name' THEN 1 ELSE 2 END AS step, ordinal,
      concat('Alter table ', table_name, ' change ', old_name, ' ', new_name, ' ', new_type, ' CASCADE;') AS statement
      FROM c JOIN t USING (table_name) WHERE kind = 'columns' AND change IN ('name', 'type')
    UNION ALL SELECT table_name, 3, min(ordinal), concat('Alter table ', table_name, ' add columns (',
      string_agg(concat(new_name, ' ', new_type), ',' ORDER BY ordinal), ') CASCADE;') FROM c JOIN t USING (table_name)
      WHERE kind = 'columns' AND change = 'added' GROUP BY table_name
    UNION ALL SELECT table_name, 1, 0, concat('ALTER TABLE `', table_name, '` REPLACE COLUMNS (', cols, ') CASCADE;') FROM whole JOIN t USING (table_name)
      WHERE kind = 'text' AND table_name IN (SELECT table_name FROM c)
    UNION ALL SELECT table_name, 1, 0, concat('ALTER TABLE `', table_name, '` REPLACE COLUMNS (', cols, ');') FROM whole JOIN t USING (table_name)
      WHERE kind IN ('whole', 'broken')""",
    f"{BOTH} evolving",
)
def change_plan(lake):
    broken = F.col("format_version") == 4
    stored = F.when(broken, "CREATE VIEW v AS SELECT 1").otherwise("CREATE TABLE t (`a` int) PARTITIONED BY (`b` int) ROW FORMAT DELIMITED")
    definitions = lake.evolving.select("table_name", stored.alias("ddl"))
    return evolution.change_plan(lake.evolving, changes(lake), lake.new_columns, evolution.uncomparable(definitions))


NEW_ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("customer", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("day", T.DateType()),
        T.StructField("urgency", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)


@query(
    "sch5_under_new_schema",
    """SELECT o_orderkey AS order_id, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS price,
      cast(cast(o_orderdate AS date) AS varchar) AS day, o_orderpriority AS urgency, true AS note_missing FROM orders""",
)
def under_new_schema(lake):
    read = evolution.under_schema(lake.orders, NEW_ORDERS)
    return read.withColumn("note_missing", F.col("note").isNull()).drop("note").withColumn(
        "day", F.col("day").cast("string")
    )


@query(
    "sch6_change_reports",
    f"""WITH {SIDES}, c AS (SELECT *, concat(cast(ordinal AS varchar), ' -> ', old_name, '(', old_type, ')') AS o,
        concat(cast(ordinal AS varchar), ' -> ', new_name, '(', new_type, ')') AS n FROM changes WHERE change <> 'dropped'),
    s AS (SELECT table_name, string_agg(concat('  From ', o, ' to ', n), chr(10) ORDER BY ordinal) FILTER (change = 'name') AS names,
        string_agg(concat('    ', cast(ordinal AS varchar), ' ', old_name, ': From ', old_type, ' to ', new_type), chr(10) ORDER BY ordinal) FILTER (change = 'type') AS types,
        string_agg(concat('    ', n), chr(10) ORDER BY ordinal) FILTER (change = 'added') AS added FROM c GROUP BY 1),
    k AS (SELECT table_name, string_agg(concat(chr(9), chr(9), cast(ordinal AS varchar), ' -> ', name, '(', type, ')'), chr(10) ORDER BY ordinal) AS text, side
        FROM (SELECT *, 'old' AS side FROM old_columns UNION ALL SELECT *, 'new' FROM new_columns) WHERE is_partition GROUP BY table_name, side),
    p AS (SELECT m.table_name, concat('Partition Column Change:', chr(10), chr(9), 'Existing Partition Column(s):', chr(10), coalesce(o.text, ''), chr(10),
        chr(9), 'New Partition Column(s):', chr(10), coalesce(n.text, '')) AS text FROM moved m LEFT JOIN k o ON o.table_name = m.table_name AND o.side = 'old'
        LEFT JOIN k n ON n.table_name = m.table_name AND n.side = 'new' WHERE partition_changed)
    SELECT t.table_name, concat_ws(concat(chr(10), chr(10)),
      concat('Namespace: ', namespace, '  Table Name: ', t.table_name, '   Format Version from Data Management: ', cast(format_version AS varchar)),
      'Column Name Changes:' || chr(10) || names, 'Column Type Changes:' || chr(10) || types, 'New Columns:' || chr(10) || added, p.text,
      CASE WHEN format_version = 2 THEN 'Delimiter Change, Existing: '','', New: ''|''' END, CASE WHEN format_version = 3 THEN 'Null Character Change, Existing: ''\\N'', New: ''null''' END,
      concat('Existing Schema:', chr(10), chr(10), '   old of ', t.table_name), concat('New Schema:', chr(10), chr(10), 'new of ', t.table_name)) AS report
    FROM evolving t LEFT JOIN s USING (table_name) LEFT JOIN p USING (table_name)
    WHERE s.table_name IS NOT NULL OR p.table_name IS NOT NULL OR format_version IN (2, 3)""",
    f"{BOTH} evolving",
)
def change_reports(lake):
    version = F.col("format_version")
    before = lake.evolving.select("table_name", F.lit(",").alias("delimiter"), F.lit("\\").alias("escape"), F.lit("\\N").alias("null_token"))
    after = lake.evolving.select(
        "table_name", F.when(version == 2, "|").otherwise(",").alias("delimiter"), F.lit("\\").alias("escape"),
        F.when(version == 3, "null").otherwise("\\N").alias("null_token"),
    )
    definitions = lake.evolving.select(
        "table_name", F.concat(F.lit("old of "), "table_name").alias("old_ddl"), F.concat(F.lit("new of "), "table_name").alias("new_ddl"))
    return evolution.change_reports(
        lake.evolving, changes(lake), lake.old_columns, lake.new_columns, flags(lake),
        evolution.mark_lines(before, after), definitions,
    )


@query(
    "sch7_format_changes",
    """SELECT concat('p', cast(p_partkey AS varchar)) AS table_name,
      p_size % 7 <> p_size % 9 AS delimiter_changed, false AS escape_changed, p_size > 25 AS null_token_changed FROM part""",
)
def format_changes(lake):
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("table_name")
    old = lake.part.select(
        name,
        F.format_string("\\u%04x", F.col("p_size") % 7).alias("delimiter"),
        F.lit("\\").alias("escape"),
        F.lit("\\N").alias("null_token"),
    )
    new = lake.part.select(
        name,
        F.format_string("\\%03d", F.col("p_size") % 9).alias("delimiter"),
        F.lit("\\").alias("escape"),
        F.when(F.col("p_size") > 25, "null").otherwise("\\N").alias("null_token"),
    )
    return evolution.format_changes(old, new, detect=True)


# Profiles ------------------------------------------------------------------


def profile_sql(column: str, kind: str, by: str = "") -> str:
    low = f"cast(min({column}) AS varchar)" if kind == "bound" else "''"
    high = f"cast(max({column}) AS varchar)" if kind == "bound" else "''"
    length = f"round(avg(length({column})), 6)" if kind == "text" else "-1.0"
    longest = f"max(length({column}))" if kind == "text" else "-1"
    trues = f"count(*) FILTER ({column})" if kind == "truth" else "-1"
    falses = f"count(*) FILTER (NOT {column})" if kind == "truth" else "-1"
    return f"""SELECT {by} '{column}' AS column_name, {low} AS low, {high} AS high, count(*) - count({column}) AS nulls,
      count(DISTINCT {column}) AS distincts, {length} AS avg_length, {longest}::BIGINT AS max_length, {trues}::BIGINT AS trues, {falses}::BIGINT AS falses"""


def shown(profiled, by=()):
    return profiled.select(
        *by, "column_name",
        F.coalesce("low", F.lit("")).alias("low"), F.coalesce("high", F.lit("")).alias("high"),
        "nulls", "distincts",
        F.round(F.coalesce("avg_length", F.lit(-1.0)), 6).alias("avg_length"),
        *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ["max_length", "trues", "falses"]],
    )


EVENT_COLUMNS = [
    ("event_id", "bound"), ("ts", "bound"), ("user_id", "bound"), ("event_type", "text"), ("value", "bound"), ("props", "text"), ("big", "truth"),
]


@query(
    "agg5_partition_profile",
    "WITH e AS (SELECT *, cast(cast(ts AS date) AS varchar) AS tdate, CASE WHEN value > 1 THEN value > 20 END AS big FROM events)\n"
    + "\nUNION ALL\n".join(profile_sql(c, k, "tdate,") + " FROM e GROUP BY tdate" for c, k in EVENT_COLUMNS),
)
def partition_profile(lake):
    dated = lake.events.select(
        F.col("ts").cast("date").cast("string").alias("tdate"), "*", F.when(F.col("value") > 1, F.col("value") > 20).alias("big")
    )
    columns = [c for c, _ in EVENT_COLUMNS]
    return shown(profile.column_profile(dated, columns, ["tdate"], exact=True), ["tdate"])


LINE_COLUMNS = [
    ("l_orderkey", "bound"), ("l_partkey", "bound"), ("l_suppkey", "bound"), ("l_linenumber", "bound"), ("l_quantity", "bound"),
    ("l_extendedprice", "bound"), ("l_discount", "bound"), ("l_tax", "bound"), ("l_returnflag", "text"), ("l_linestatus", "text"),
    ("l_shipdate", "bound"),
]


@query(
    "agg5_table_profile",
    "\nUNION ALL\n".join(
        profile_sql(c, k) + " FROM lineitem"
        for c, k in LINE_COLUMNS
    ),
)
def table_profile(lake):
    return shown(profile.column_profile(lake.lineitem, [c for c, _ in LINE_COLUMNS], exact=True))


@query(
    "agg5_text_profile",
    "\nUNION ALL\n".join(
        profile_sql(c, k, "lang,") + " FROM documents GROUP BY lang"
        for c, k in [("doc_id", "bound"), ("text", "text"), ("source", "text"), ("n_chars", "bound")]
    ),
)
def text_profile(lake):
    profiled = profile.column_profile(lake.documents, ["doc_id", "text", "source", "n_chars"], ["lang"], exact=True)
    return shown(profiled, ["lang"])


ESTIMATED = [c for c in LINE_COLUMNS if c[0] != "l_linestatus"]


@query(
    "agg5_estimated_profile",
    "SELECT * REPLACE (true AS distincts) FROM (" + "\nUNION ALL\n".join(
        profile_sql(c, k, "l_linestatus,") + " FROM lineitem GROUP BY l_linestatus" for c, k in ESTIMATED
    ) + ")",
)
def estimated_profile(lake):
    """The profile as it runs at scale; an estimate may be a fifth off, four standard errors."""
    columns, by = [c for c, _ in ESTIMATED], ["l_linestatus"]
    estimated = shown(profile.column_profile(lake.lineitem, columns, by), by)
    exact = profile.column_profile(lake.lineitem, columns, by, exact=True).select(
        *by, "column_name", F.col("distincts").alias("_exact")
    )
    near = F.abs(F.col("distincts") - F.col("_exact")) <= 0.2 * F.col("_exact")
    return estimated.join(exact, [*by, "column_name"]).withColumn("distincts", near).drop("_exact")


def states_sql(columns, by="", table="lineitem"):
    """The profile with distinct counts up to a hundred, where a sketch holds them all."""
    few = "CASE WHEN distincts <= 100 THEN distincts ELSE -1 END"
    whole = "\nUNION ALL\n".join(profile_sql(c, k, by) + f" FROM {table}" + (f" GROUP BY {by.strip(',')}" if by else "") for c, k in columns)
    return f"SELECT * REPLACE ({few} AS distincts) FROM (\n{whole})"


def few_distincts(profiled):
    return profiled.withColumn("distincts", F.when(F.col("distincts") <= 100, F.col("distincts")).otherwise(-1))


@query("agg5_merged_profile", states_sql(LINE_COLUMNS))
def merged_profile(lake):
    """A table's profile from the states of its months, saved in two loads, the second of which replaces some."""
    path, month = work_dir(lake.spark, "states"), F.date_format("l_shipdate", "yyyy-MM")
    columns = [c for c, _ in LINE_COLUMNS]
    dated = lake.lineitem.withColumn("month", month)
    early = dated.where("month < '1996'")
    statistics.save_states(statistics.column_states(early.where("l_linenumber < 3"), columns, ["month"]), path, ["month"])
    statistics.save_states(statistics.column_states(dated, columns, ["month"]), path, ["month"])
    merged = statistics.merged_states(statistics.saved_states(lake.spark, path, {"month": "string"}))
    return few_distincts(shown(statistics.profile_of_states(merged)))


@query(
    "agg5_weekday_profile",
    "WITH e AS (SELECT *, dayofweek(ts) AS weekday, CASE WHEN value > 1 THEN value > 20 END AS big FROM events)\n"
    + states_sql(EVENT_COLUMNS, "weekday,", "e"),
)
def weekday_profile(lake):
    """States kept per day, merged to the days of the week."""
    columns, path = [c for c, _ in EVENT_COLUMNS], work_dir(lake.spark, "states")
    dated = lake.events.withColumn("tdate", F.col("ts").cast("date")).withColumn("big", F.when(F.col("value") > 1, F.col("value") > 20))
    statistics.save_states(statistics.column_states(dated, columns, ["tdate"]), path, ["tdate"])
    kept = statistics.saved_states(lake.spark, path, {"tdate": "date"}).withColumn("weekday", (F.dayofweek("tdate") - 1).cast("long"))
    return few_distincts(shown(statistics.profile_of_states(statistics.merged_states(kept, ["weekday"]), ["weekday"]), ["weekday"]))
