"""Registration requests: validation, effects on registrations, back-load status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import names, workflow
from quayside.functions.names import OBJECT_KEY

# What a request may say.
WORKFLOWS = {"DM Managed": workflow.MANAGED_JOB, "Singleton": workflow.SINGLETON_JOB}
ACTIONS = ["add", "drop", "enable", "disable"]
REGISTRATION = ["notification_name", *OBJECT_KEY, "kind", "status_filter", "job_name", "status"]


def validated(requests: DataFrame, json_files: DataFrame | None = None) -> DataFrame:
    """Requests with `notification_name` and `reason`, null for an accepted one.

    The first rule that fails gives the reason. `json_files` has `json_file` and
    `content`; without it, named files are taken as they are.
    """
    named = requests.withColumn(
        "notification_name", names.notification_name(*[F.col(c) for c in OBJECT_KEY])
    )
    if json_files is not None:
        known = json_files.select("json_file", "content", F.lit(True).alias("_found"))
        named = named.join(known, "json_file", "left")
    required = [F.col(c) == "" for c in [*OBJECT_KEY, "workflow", "action"]]
    absent = required[0]
    for test in required[1:]:
        absent = absent | test
    reason = (
        F.when(F.col("line").rlike(r"[^A-Za-z0-9|_.\- ]"), "Line contains bad characters.")
        .when(absent, "Missing expected parameter from line.")
        .when(
            F.col("notification_name").rlike("[^A-Za-z0-9_]"),
            "Notification name contains bad characters.",
        )
    )
    if json_files is not None:
        asked = F.col("json_file") != ""
        reason = reason.when(asked & F.col("_found").isNull(), "Expected json file not present.").when(
            asked & F.try_parse_json("content").isNull(), "The json file contains formatting errors."
        )
    reason = reason.when(
        ~F.col("workflow").isin(list(WORKFLOWS)), "Invalid workflow type provided."
    ).when(~F.col("action").isin(ACTIONS), "Invalid action provided.")
    return named.withColumn("reason", reason).drop("_found")


def split_requests(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected requests."""
    return judged.where("reason is null"), judged.where("reason is not null")


def back_load_status(judged: DataFrame) -> DataFrame:
    """What each request line means for back-loading."""
    starting = F.col("action").isin("add", "enable")
    return judged.withColumn(
        "back_load",
        F.when(~starting, "invalid action")
        .when(F.col("reason").isNotNull(), "not submitted")
        .when(F.col("workflow").isin(list(WORKFLOWS)), "submitted")
        .otherwise("invalid workflow"),
    )


def with_formats(accepted: DataFrame, registrations: DataFrame, formats: DataFrame) -> DataFrame:
    """Requests that can take effect: drops, names registered before, and objects with a registered format.

    A name that a drop frees needs its format again.
    """
    known = formats.select(*OBJECT_KEY, F.lit(True).alias("_format")).distinct()
    named = registrations.select("notification_name", F.lit(True).alias("_named")).distinct()
    dropped = accepted.where("action = 'drop'").select("notification_name", F.lit(True).alias("_freed")).distinct()
    judged = (
        accepted.join(known, OBJECT_KEY, "left").join(named, "notification_name", "left")
        .join(dropped, "notification_name", "left")
    )
    update = F.col("_named").isNotNull() & F.col("_freed").isNull()
    return judged.where((F.col("action") == "drop") | F.col("_format") | update).select(*accepted.columns)


def merged_registrations(
    registrations: DataFrame, accepted: DataFrame, order: str = "place", formats: DataFrame | None = None
) -> DataFrame:
    """The registrations after the accepted requests, taken in their order.

    With `formats`, a new registration takes effect only if its object's format is
    registered; one that exists is updated.

    The last request on a name decides its own registration and its mail-only
    one. The storage registrations follow the last request that was a drop or
    had the managed workflow, as singletons leave them alone.
    """
    if formats is not None:
        accepted = with_formats(accepted, registrations, formats)
    latest = F.max(F.struct(order, "action", "workflow"))
    job = F.lit(None)
    for label, name in WORKFLOWS.items():
        job = F.when(F.col("last.workflow") == label, name).otherwise(job)
    key = ["notification_name", *OBJECT_KEY]
    last = accepted.groupBy(*key).agg(latest.alias("last")).withColumn("job", job)
    touching = (F.col("action") == "drop") | (F.col("workflow") == "DM Managed")
    storage = accepted.where(touching).groupBy(*key).agg(latest.alias("last")).withColumn("job", job)

    alive = F.col("last.action") != "drop"
    own = last.where(alive).select(
        *key,
        F.lit("data").alias("kind"),
        F.lit("").alias("status_filter"),
        F.col("job").alias("job_name"),
        F.when(F.col("last.action") == "disable", "DISABLED").otherwise("ENABLED").alias("status"),
    )
    mail = last.where("last.action = 'disable'").select(
        F.concat("notification_name", F.lit("_EMAIL")).alias("notification_name"),
        *OBJECT_KEY,
        F.lit("data").alias("kind"),
        F.lit("").alias("status_filter"),
        F.lit(workflow.MAIL_ONLY_JOB).alias("job_name"),
        F.lit("ENABLED").alias("status"),
    )
    events = names.storage_notifications(F.col("notification_name"))
    lifecycle = storage.where(alive).select("*", F.explode(events).alias("event")).select(
        F.col("event.name").alias("notification_name"),
        *OBJECT_KEY,
        F.lit("storage").alias("kind"),
        F.col("event.status").alias("status_filter"),
        F.col("job").alias("job_name"),
        F.lit("ENABLED").alias("status"),
    )
    replaced = (
        last.select("notification_name")
        .unionByName(
            last.select(F.concat("notification_name", F.lit("_EMAIL")).alias("notification_name"))
        )
        .unionByName(
            storage.select(F.explode(events).alias("event")).select(
                F.col("event.name").alias("notification_name")
            )
        )
        .distinct()
    )
    kept = registrations.join(replaced, "notification_name", "left_anti").select(*REGISTRATION)
    return kept.unionByName(own).unionByName(mail).unionByName(lifecycle)


def drop_items(accepted: DataFrame) -> DataFrame:
    """A drop item per accepted drop request."""
    return accepted.where(F.col("action") == "drop").select(
        *OBJECT_KEY,
        F.lit(workflow.DROP).alias("wf_type"),
        F.lit("drop").alias("execution_id"),
        F.lit("").alias("partition_values"),
    )
