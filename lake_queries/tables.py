"""The lake's tables as projections of the given ones.

Each projection is one SQL text that Spark and the checking engine both read;
`{name}` stands for a given table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

AS_OF = "2001-06-01 00:00:00"
AS_OF_DATE = "2001-06-01"

# The object an order, customer or supplier belongs to.
_KEY = """concat('ns.', cast(obj % 7 as string), '-a b') as namespace,
       concat('OBJ-', cast(obj as string)) as object_name,
       case obj % 2 when 0 then 'PRC' else 'UNV 2' end as usage_code,
       case obj % 3 when 0 then 'ORC' when 1 then 'TXT' else 'BZ' end as file_type"""

TABLES = {
    "notifications": """
select o_orderkey as id, <key>,
       cast(o_orderdate as timestamp) as date_created,
       case when wf = 1 and o_orderkey % 2 = 0 then 'partition'
            when o_orderkey % 5 = 2 and o_orderkey % 2 = 1 then 'tdate,region,kind'
            else 'tdate' end as partition_key,
       case when wf = 1 and o_orderkey % 2 = 0 then 'none'
            when o_orderkey % 5 < 2 then cast(d as string)
            when o_orderkey % 5 = 2 then concat(cast(d as string), ',',
                 cast(cast(d + interval '1' day as date) as string), ',',
                 cast(cast(d + interval '2' day as date) as string))
            when o_orderkey % 5 = 3 then concat(
                 cast(cast(d + interval '4' day as date) as string), '__', cast(d as string))
            else concat(cast(d as string), ':', cast(o_orderkey % 7 + 1 as string)) end as partition_values,
       cast(wf as int) as wf_type,
       case o_orderkey % 11
            when 0 then concat('{{"businessObject":{{"late_reporting_for":"OBJ-', cast(obj + 1 as string),
                        '","storageNames":["S3_A","S3_B"]}}}}')
            when 1 then concat('{{"businessObject":{{"original_object_name":"Old.Name ', cast(obj as string), '"}}}}')
            when 2 then '{{bad json'
            when 3 then 'null'
            when 4 then ''
            when 5 then '{{"processing":{{"collectStatistics":"none"}}}}'
            when 6 then '{{"processing":{{"collectStatistics":"N"}},"businessObject":{{"storageNames":["X"]}}}}'
            else cast(null as string) end as correlation_data,
       concat('exec-', cast(o_orderkey % 100 as string)) as execution_id,
       concat('cl-', cast(o_orderkey % 3 as string)) as cluster_name
from (select *, cast(o_orderdate as date) as d, cast(floor(o_custkey / 10) as bigint) as obj,
             case o_orderkey % 9 when 0 then 0 when 1 then 0 when 2 then 0 when 3 then 1 when 4 then 3
                  when 5 then 5 when 6 then 7 when 7 then 8 else 33 end as wf
      from {orders})""",
    "processing_log": """
select l_orderkey * 10 + l_linenumber as id, l_orderkey as notification_id,
       cast(l_shipdate as timestamp) as date_processed,
       cast(l_shipdate as timestamp) + interval '1' hour as end_time,
       case l_returnflag when 'A' then 'Y' when 'R' then 'N' else 'P' end as success,
       concat('C', cast(l_suppkey % 5 as string)) as cluster_id
from {lineitem}""",
    "leases": """
select <key>, cluster_id, worker_id, wf_type, expiration_dt from (
  select obj, concat('C', cast(min(c_nationkey) % 5 as string)) as cluster_id,
         concat('W', cast(min(c_custkey) % 3 as string)) as worker_id,
         cast(case when min(c_nationkey) % 4 = 0 then 5 else 0 end as int) as wf_type,
         case when min(c_acctbal) < -500 then timestamp '<as_of>' - interval '1' day
              else timestamp '<as_of>' + interval '3' minute end as expiration_dt
  from (select *, cast(floor(c_custkey / 10) as bigint) as obj from {customer}) group by obj)""",
    "workflows": """
select cast(case r_regionkey when 0 then 0 when 1 then 1 when 2 then 5 when 3 then 7 else 9 end as int) as workflow_id,
       cast(10 + r_regionkey % 3 as int) as priority, r_name as workflow_name
from {region}""",
    "object_data": """
select <key>,
       cast(cast(l_shipdate as date) as string) as partition_value,
       case when l_suppkey % 3 = 0 then cast(null as string) else cast(l_linenumber as string) end as sub_value,
       cast(l_orderkey % 3 + 1 as int) as format_version, l_orderkey as data_version,
       case l_linestatus when 'O' then 'VALID' else 'ARCHIVED' end as status,
       concat('s3://lake/', cast(obj as string), '/', cast(cast(l_shipdate as date) as string), '/',
              cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_linenumber as string)) as file_path,
       cast(l_quantity * 1000 as bigint) as file_size
from (select *, l_suppkey as obj from {lineitem})
union all
select <key>, 'none', cast(null as string), 1, obj + k, 'VALID',
       concat('s3://lake/', cast(obj as string), '/whole/', cast(k as string)), 1000
from (select *, s_suppkey as obj from {supplier} cross join (select 0 as k union all select 1 as k))""",
    "databases": """
select s_suppkey as db_id, <db> as db_name,
       case when s_suppkey % 10 = 9 and s_acctbal < 3000 then concat('s3://old/', <db>, '.db')
            when s_suppkey % 10 = 9 then concat('s3://home/', <db>, '.db')
            else concat('s3://lake/CATALOG/', <db>, '.db') end as db_location
from (select *, s_suppkey as dbk from {supplier})""",
    "tables": """
select p_partkey as tbl_id, dbk as db_id, concat('t', cast(p_partkey as string)) as tbl_name
from (<parts>)""",
    "permission_lists": """
select concat('DB', cast(cast(floor(c_custkey / 15) as bigint) as string)) as namespace,
       concat('u', cast(c_custkey as string)) as user_id,
       case c_mktsegment when 'BUILDING' then 'READ,WRITE' when 'MACHINERY' then 'WRITE' else 'READ' end as permission_list
from {customer}
union all
select concat('DB', cast(c_nationkey as string)), concat('u', cast(c_custkey as string)),
       case when c_acctbal > 2000 then 'READ' else 'GRANT' end from {customer}
union all
select concat('DB', cast(s_suppkey as string)), '*', case when s_acctbal > 5000 then 'READ' else 'WRITE' end from {supplier}""",
    "grants": """
select 'USER' as principal_type, concat('u', cast(pk * 15 + p_size % 15 as string)) as principal, <db> as db_name,
       concat('t', cast(p_partkey as string)) as tbl_name, 'SELECT' as privilege from (<parts>)
union all
select 'ROLE', 'public', <db>, concat('t', cast(p_partkey as string)), 'SELECT' from (<parts>) where p_size > 25
union all
select 'ROLE', concat('app_lake_acl_ro_db', cast(dbk as string)), <db>, concat('t', cast(p_partkey as string)), 'SELECT'
from (<parts>) where p_size < 30
union all
select 'USER', concat('u', cast(dbk * 15 as string)), <db>, concat('t', cast(p_partkey as string)), 'INSERT'
from (<parts>) where p_size < 40""",
    "roles": """
select s_suppkey as role_id, concat('app_lake_acl_', case s_suppkey % 3 when 0 then 'ro' when 1 then 'rw' else 'w' end,
       '_db', cast(s_suppkey as string)) as role_name from {supplier}
union all select cast(-1 - r_regionkey as bigint), case r_regionkey when 0 then 'app_lake_acl_ro_public' else concat('plain ', r_name) end from {region}""",
    "role_map": """
select cast(floor(c_custkey / 15) as bigint) as role_id, concat('u', cast(c_custkey as string)) as principal_name,
       case when c_nationkey < 3 then 'ROLE' else 'USER' end as principal_type from {customer} where c_acctbal > 1000
union all
select cast(-1 as bigint), concat('u', cast(c_custkey as string)), 'USER' from {customer} where c_acctbal > 5000""",
    "members": """
select case when c_nationkey < 15 then concat('APP_LAKE_ACL_', case cast(floor(c_custkey / 15) as bigint) % 3
            when 0 then 'RO' when 1 then 'RW' else 'W' end, '_db', cast(cast(floor(c_custkey / 15) as bigint) as string))
            else 'APP_LAKE_Users' end as group_cn,
       c_custkey as ordinal, concat('cn=u', cast(c_custkey as string), ',ou=People') as member_dn from {customer}""",
    "old_columns": """
select concat('t', cast(tab as string)) as table_name, false as is_partition, ordinal, name, type
from (<columns>) where ordinal < 14 + tab % 5
union all select concat('t', cast(s_suppkey as string)), true, 0, 'tdate', 'date' from {supplier}""",
    "new_columns": """
select concat('t', cast(tab as string)) as table_name, false as is_partition, ordinal,
       case when p_size > 45 then concat(name, '_new') when p_size > 35 then upper(name) else name end as name,
       case when p_size < 6 then 'string' when p_size < 20 then upper(type) else type end as type
from (<columns>) where ordinal < 18 - tab % 4 and tab % 10 < 9
union all
select concat('t', cast(tab as string)), false, ordinal, name, type
from (<columns>) where ordinal < 14 + tab % 5 and tab % 10 = 9
union all
select concat('t', cast(s_suppkey as string)), true, 0, 'TDATE', case when s_acctbal < 2000 then 'string' else 'DATE' end from {supplier}
union all
select concat('t', cast(s_suppkey as string)), true, 1, 'region', 'string' from {supplier} where s_nationkey < 5 or s_suppkey % 3 <> 0""",
    "evolving": """
select concat('t', cast(s_suppkey as string)) as table_name, concat('NS', cast(s_nationkey as string)) as namespace,
       cast(s_suppkey % 9 + 1 as int) as format_version,
       case s_suppkey % 3 when 0 then 'TXT' else 'ORC' end as file_type,
       cast(case when s_suppkey % 8 = 3 then 1 else 0 end as int) as wf_type,
       case when s_suppkey % 16 = 3 then 'partition' else 'tdate' end as partition_key
from {supplier}""",
    "arrivals": """
select event_id, case when value > 12 then 'STRGE_UNIT_STTS_CHG' else 'BUS_OBJCT_DATA_STTS_CHG' end as event_type,
       <key>, 'tdate' as partition_key, cast(cast(ts as date) as string) as partition_value,
       case event_type when 'click' then 'ARCHIVING' when 'error' then 'EXPIRING' when 'view' then 'VALID' when 'signup' then 'VALID' else 'RESTORED' end as new_status,
       case when value < 5 then 'S3_A' else 'S3_MANAGED' end as storage_name
from (select *, user_id as obj from {events})""",
    "arrival_registrations": """
select concat('R', cast(s_suppkey as string)) as notification_name, namespace,
       case when s_acctbal < 3000 then 'STRGE_UNIT_STTS_CHG' else 'BUS_OBJCT_DATA_STTS_CHG' end as event_type,
       object_name, case when s_nationkey < 6 then cast(null as string) else usage_code end as usage_code,
       case when s_nationkey between 3 and 12 then cast(null as string) else file_type end as file_type,
       case when s_suppkey % 4 = 0 then cast(null as string) when s_acctbal < 3000 then 'ARCHIVING' else 'VALID' end as new_status,
       case when s_suppkey % 5 < 3 then cast(null as string) else 'S3_MANAGED' end as storage_name,
       case when s_nationkey = 7 then 'DISABLED' else 'ENABLED' end as status,
       case s_suppkey % 6 when 0 then 'singletonObjectsAddPartitionWorkflow' when 1 then 'emailDisabledObjectsWorkflow'
            else 'addPartitionWorkflow' end as job_name,
       concat('corr', cast(s_suppkey as string)) as correlation_data
from (select *, <key> from (select *, s_suppkey as obj from {supplier}))
union all
select concat('N', cast(n_nationkey as string)), concat('ns.', cast(n_nationkey as string), '-a b'), 'STRGE_UNIT_STTS_CHG',
       cast(null as string), cast(null as string), case when n_regionkey < 2 then 'ORC' end, 'EXPIRING', cast(null as string),
       'ENABLED', 'addPartitionWorkflow', n_name from {nation}""",
    "requests": """
select c_custkey as line_no,
  case c_custkey % 13
    when 0 then concat('# ', c_name)
    when 1 then concat('  ', c_mktsegment, 'ns | OBJ-', o, '| PRC |TXT|DM Managed|', a, '|')
    when 2 then concat(c_mktsegment, '@ns|OBJ-', o, '|PRC|TXT|DM Managed|', a, '|')
    when 3 then concat(c_mktsegment, '|OBJ-', o, '||TXT|DM Managed|', a, '|')
    when 4 then concat(c_mktsegment, '|OBJ-', o, '|PRC|TXT|Batch|', a, '|')
    when 5 then concat(c_mktsegment, '|OBJ-', o, '|PRC|TXT|Singleton|remove|')
    when 6 then concat(c_mktsegment, '|OBJ-', o, '|PRC|TXT|DM Managed|', a, '|f', cast(c_nationkey as string), '.json|')
    when 7 then concat(c_mktsegment, '|OBJ-', o, '|PRC|BZ|Singleton|', a, '|')
    else concat(c_mktsegment, 'ns|OBJ-', o, '|PRC|TXT|DM Managed|', a, '|') end as line
from (select *, cast(cast(floor(c_custkey / 40) as bigint) as string) as o,
       case when c_acctbal < 2500 then 'add' when c_acctbal < 5000 then 'enable' when c_acctbal < 7500 then 'disable' else 'drop' end as a
      from {customer})""",
    "json_files": """
select concat('f', cast(n_nationkey as string), '.json') as json_file,
       case when n_regionkey = 1 then '{{"a": 1' else concat('{{"a": "', n_name, '"}}') end as content
from {nation} where n_regionkey < 4""",
    "existing_registrations": """
select distinct concat(c_mktsegment, 'ns_OBJ_', o, '_PRC_TXT') as notification_name, concat(c_mktsegment, 'ns') as namespace,
       concat('OBJ-', o) as object_name, 'PRC' as usage_code, 'TXT' as file_type, 'data' as kind, '' as status_filter,
       'addPartitionWorkflow' as job_name, 'DISABLED' as status
from (select *, cast(cast(floor(c_custkey / 25) as bigint) as string) as o from {customer})
union all
select distinct concat(c_mktsegment, 'ns_OBJ_', o, '_PRC_TXT_EMAIL'), concat(c_mktsegment, 'ns'), concat('OBJ-', o), 'PRC', 'TXT',
       'data', '', 'emailDisabledObjectsWorkflow', 'ENABLED'
from (select *, cast(cast(floor(c_custkey / 25) as bigint) as string) as o from {customer})""",
    "date_keyed": """
select <key>, obj % 4 <> 0 as is_date from (select s_suppkey as obj from {supplier})""",
}


# Name of database `dbk`, parts with their database, and parts as table columns.
_DB = """case when dbk % 10 = 9 then concat('user_u', cast(dbk * 15 as string)) else concat('db', cast(dbk as string)) end"""
_PARTS = """select *, case when pk % 7 = 3 then pk + 1 else pk end as dbk
  from (select *, cast(floor(p_partkey / 20) as bigint) as pk from {part})"""
_COLUMNS = """select *, cast(floor(p_partkey / 20) as bigint) as tab, cast(p_partkey % 20 as int) as ordinal,
  concat(lower(p_type), '_', cast(p_partkey % 20 as string)) as name,
  case p_partkey % 6 when 0 then 'DECIMAL' when 1 then 'decimal(10)' when 2 then concat('DECIMAL(12,', cast(p_size % 4 as string), ')')
       when 3 then 'bigint' when 4 then 'string' else concat('varchar(', cast(p_size as string), ')') end as type from {part}"""
_PIECES = {"<key>": _KEY, "<as_of>": AS_OF, "<parts>": _PARTS, "<columns>": _COLUMNS, "<db>": _DB}


def text_of(name: str) -> str:
    text = TABLES[name].strip()
    for mark, piece in _PIECES.items():
        text = text.replace(mark, piece)
    return text


def table_sql(name: str) -> str:
    """The projection as the checking engine reads it."""
    return text_of(name).format(**{t: t for t in GIVEN})


class Lake:
    """The given tables below one folder and the lake's tables made from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def projected(self, name: str) -> DataFrame:
        text = text_of(name)
        needed = {t: self.given(t) for t in GIVEN if "{" + t + "}" in text}
        return self.spark.sql(text, **needed)

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.given(name)
        if name in TABLES:
            return self.projected(name)
        raise AttributeError(name)

    def streamed(self, name: str, source: str) -> DataFrame:
        """A projection of one given table, read as a stream."""
        schema = self.given(source).schema
        # A pattern, as a stream cannot take a single file for its folder.
        stream = self.spark.readStream.schema(schema).parquet(f"{self.folder}/{source}.parque[t]")
        return self.spark.sql(text_of(name), **{source: stream})

    @cached_property
    def permissions(self) -> DataFrame:
        """`permission_lists` with the permissions as an array."""
        return self.projected("permission_lists").withColumn(
            "permissions", F.split("permission_list", ",")
        ).drop("permission_list")

    @cached_property
    def registered_data(self) -> DataFrame:
        """`object_data` with sub-partition values as an array."""
        subs = F.when(F.col("sub_value").isNotNull(), F.array("sub_value"))
        return self.projected("object_data").withColumn("sub_partition_values", subs).drop("sub_value")
