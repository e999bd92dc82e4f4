"""Names derived from an object key, its correlation document and its storage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT_KEY = ["namespace", "object_name", "usage_code", "file_type"]


def sanitised(name: Column) -> Column:
    """Full stop, space and hyphen become underscores."""
    return F.translate(name, ". -", "___")


def database_name(namespace: Column) -> Column:
    return sanitised(namespace)


def actual_object_name(object_name: Column, correlation: Column) -> Column:
    """The object a late-reporting feed stands for, else the object itself."""
    return F.coalesce(
        F.get_json_object(correlation, "$.businessObject.late_reporting_for"), object_name
    )


def table_name(
    object_name: Column, usage_code: Column, file_type: Column, correlation: Column
) -> Column:
    original = F.get_json_object(correlation, "$.businessObject.original_object_name")
    base = F.coalesce(original, actual_object_name(object_name, correlation))
    return sanitised(F.concat_ws("_", base, usage_code, file_type))


def storage_names(correlation: Column) -> Column:
    listed = F.get_json_object(correlation, "$.businessObject.storageNames")
    return F.coalesce(F.array_join(F.from_json(listed, "array<string>"), ","), F.lit("?"))


def collects_statistics(correlation: Column) -> Column:
    """True unless the correlation document says NONE, in any case."""
    asked = F.get_json_object(correlation, "$.processing.collectStatistics")
    return F.coalesce(F.upper(asked) != "NONE", F.lit(True))


def user_schema(user: Column, fold_case: bool = True) -> Column:
    return F.concat(F.lit("user_"), F.lower(user) if fold_case else user)


def user_schema_location(root: str, user: Column, fold_case: bool = True) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), user_schema(user, fold_case), F.lit(".db"))


def storage_path(
    namespace: Column,
    data_provider: Column,
    usage_code: Column,
    file_type: Column,
    object_name: Column,
    format_version: Column,
    data_version: Column,
    partition_key: Column,
    partition_value: Column,
    sub_partitions: Column | None = None,
    hyphenated: bool = False,
) -> Column:
    """Folder of one partition version.

    `sub_partitions` is an ordered map from key to value. `hyphenated` gives the
    spelling some storages use: lower case, hyphens for underscores.
    """
    head = F.concat_ws(
        "/",
        namespace,
        data_provider,
        usage_code,
        file_type,
        object_name,
        F.concat(F.lit("schm-v"), format_version.cast("string")),
        F.concat(F.lit("data-v"), data_version.cast("string")),
        F.concat(partition_key, F.lit("="), partition_value),
    )
    if sub_partitions is not None:
        tail = F.array_join(
            F.transform(F.map_entries(sub_partitions), lambda e: F.concat(e.key, F.lit("="), e.value)),
            "/",
        )
        head = F.when(tail != "", F.concat_ws("/", head, tail)).otherwise(head)
    return F.lower(F.translate(head, "_", "-")) if hyphenated else head


def notification_name(*key_parts: Column) -> Column:
    return sanitised(F.concat_ws("_", *key_parts))


def storage_notifications(name: Column) -> Column:
    """The three storage-lifecycle registrations that go with `name`."""
    return F.array(
        *[
            F.struct(F.concat(name, F.lit(suffix)).alias("name"), F.lit(status).alias("status"))
            for suffix, status in STORAGE_EVENTS
        ]
    )


# Registration suffix and the storage status it listens for.
STORAGE_EVENTS = [("_ARCHIVE", "ARCHIVING"), ("_RESTORE", "RESTORED"), ("_EXPIRE", "EXPIRING")]
