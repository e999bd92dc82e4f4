"""Declared columns of the lake's tables, for scans that infer nothing."""

from __future__ import annotations

from pyspark.sql import types as T

_KEY = "namespace string, object_name string, usage_code string, file_type string"

TABLES = {
    "notifications": f"id long, {_KEY}, date_created timestamp, partition_key string, partition_values string, "
    "wf_type int, correlation_data string, execution_id string, cluster_name string",
    "processing_log": "id long, notification_id long, date_processed timestamp, end_time timestamp, success string, "
    "cluster_id string",
    "leases": f"{_KEY}, cluster_id string, worker_id string, wf_type int, expiration_dt timestamp",
    "workflows": "workflow_id int, priority int, workflow_name string",
    "object_data": f"{_KEY}, partition_value string, sub_partition_values array<string>, format_version int, "
    "data_version long, status string, storage_name string, file_path string, file_size long",
    "table_partitions": "table_name string, partition_value string, part_name string, location string",
    "table_columns": "table_name string, is_partition boolean, ordinal int, name string, type string",
    "format_columns": f"{_KEY}, is_partition boolean, ordinal int, name string, type string, size string, "
    "required boolean, description string",
    "databases": "db_id long, db_name string, db_location string",
    "tables": "tbl_id long, db_id long, tbl_name string",
    "roles": "role_id long, role_name string",
    "role_map": "role_id long, principal_name string, principal_type string",
    "grants": "principal_type string, principal string, db_name string, tbl_name string, privilege string, "
    "grant_option boolean",
    "permissions": "namespace string, user_id string, permissions array<string>",
    "members": "group_cn string, ordinal long, member_dn string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def column_type(name: str, size: str | None = None) -> T.DataType:
    """Spark type of a registered column type. Sized text is read as text."""
    text = name.strip().lower()
    if text.startswith(("varchar", "char")):
        return T.StringType()
    if text == "datetime":
        return T.TimestampType()
    if text == "decimal" and size:
        text = f"decimal({size})"
    return T.StructType.fromDDL(f"c {text}")["c"].dataType
