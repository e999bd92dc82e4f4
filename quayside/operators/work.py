"""Work items, their attempts, eligibility, batches, backlog and retirement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quayside.functions import names, partitions, workflow
from quayside.functions.names import OBJECT_KEY
from quayside.operators.runs import number_runs
from quayside.session import stable


def moment(as_of) -> Column:
    """A timestamp column from a column, a datetime or its text."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def of_class(wf_type: Column, stats: bool) -> Column:
    return workflow.is_stats(wf_type) if stats else workflow.is_load(wf_type)


# Attempts ------------------------------------------------------------------


def attempt_rollup(log: DataFrame) -> DataFrame:
    """Attempts, last start and last outcome per work item.

    An outcome is one letter. It rides behind its attempt's id in one decimal, wide
    enough for every long, so all three are numbers and aggregate in a hash table
    where a struct or a text would have to be sorted. An attempt without an outcome
    counts like any other.
    """
    letter = F.coalesce(F.ascii("success"), F.lit(0))
    marked = (F.col("id").cast("decimal(20,0)") * 256 + letter).cast("decimal(38,0)")
    return (
        log.groupBy("notification_id")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.max("date_processed").alias("last_process"),
            F.max(marked).alias("_last"),
        )
        .withColumn("_last", F.pmod("_last", F.lit(256)).cast("int"))
        .withColumn("last_outcome", F.when(F.col("_last") > 0, F.char(F.col("_last"))))
        .drop("_last")
    )


def attempt_history(log: DataFrame, ids_per_piece: int = 65536) -> DataFrame:
    """The rollup plus all outcomes as one comma list in order of the attempts.

    Pieces of the list are built first so that no task sorts all attempts of an
    item; the second step joins finished pieces.
    """
    piece = log.groupBy(
        "notification_id", F.floor(F.col("id") / ids_per_piece).alias("piece")
    ).agg(
        F.expr("listagg(success, ',') within group (order by id, success)").alias("outcomes"),
        F.count(F.lit(1)).alias("attempts"),
        F.max("date_processed").alias("last_process"),
    )
    return piece.groupBy("notification_id").agg(
        F.expr("listagg(outcomes, ',') within group (order by piece)").alias("outcomes"),
        F.sum("attempts").alias("attempts"),
        F.max("last_process").alias("last_process"),
    )


def with_attempts(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items with their rollup; an item never attempted has zero attempts."""
    rolled = attempt_rollup(log).withColumnRenamed("notification_id", "id")
    return items.join(rolled, "id", "left").withColumn(
        "attempts", F.coalesce("attempts", F.lit(0).cast("long"))
    )


def with_priority(items: DataFrame, workflows: DataFrame) -> DataFrame:
    """Priority of the item's workflow; null for an unknown one."""
    priorities = workflows.select(F.col("workflow_id").alias("wf_type"), "priority")
    return items.join(priorities, "wf_type", "left")


def last_outcome_is(items: DataFrame, outcome: str) -> DataFrame:
    return items.where(F.col("last_outcome") == outcome)


def retry_due(as_of, max_attempts: int, retry_seconds: int) -> Column:
    waited = F.timestamp_diff("SECOND", F.col("last_process"), moment(as_of))
    return (F.col("attempts") < max_attempts) & (waited > retry_seconds)


def not_leased_elsewhere(
    items: DataFrame, leases: DataFrame, cluster_id: str, stats: bool = False, match_on: str = "raw"
) -> DataFrame:
    """Items whose object no other cluster holds a lease of this class on.

    Leases carry the actual object name. `raw` compares it with the item's own
    name, `actual` with the name its correlation document stands for.
    """
    held = leases.where((F.col("cluster_id") != cluster_id) & of_class(F.col("wf_type"), stats))
    held = held.select(*OBJECT_KEY)
    if match_on == "raw":
        return items.join(held, OBJECT_KEY, "left_anti")
    keyed = items.withColumn(
        "_actual", names.actual_object_name(F.col("object_name"), F.col("correlation_data"))
    )
    key = ["namespace", "_actual", "usage_code", "file_type"]
    return keyed.join(
        held.withColumnRenamed("object_name", "_actual"), key, "left_anti"
    ).select(*items.columns)


def eligible_work(
    items: DataFrame,
    log: DataFrame,
    workflows: DataFrame,
    leases: DataFrame,
    *,
    as_of,
    max_attempts: int,
    retry_seconds: int,
    cluster_id: str,
    stats: bool = False,
    match_on: str = "raw",
) -> DataFrame:
    """Items that may be worked on now, unordered; see `in_work_order`."""
    wanted = items.where(of_class(F.col("wf_type"), stats))
    tried = with_attempts(wanted, log)
    due = tried.where(
        (F.col("attempts") == 0)
        | (~F.coalesce(F.col("last_outcome") == "Y", F.lit(False)) & retry_due(as_of, max_attempts, retry_seconds))
    )
    free = not_leased_elsewhere(due, leases, cluster_id, stats, match_on)
    return with_priority(free, workflows)


def work_order() -> list[Column]:
    """Lowest priority number first, unknown ones before all; latest values first."""
    return [
        F.col("priority").asc_nulls_first(),
        F.col("partition_values").desc_nulls_last(),
        F.col("id").asc(),
    ]


def in_work_order(items: DataFrame) -> DataFrame:
    return items.orderBy(*work_order())


def _behind(row: Row) -> Column:
    """Whether an item comes after `row` in work order."""
    priority, values = F.col("priority"), F.col("partition_values")
    lower = priority.isNotNull() if row.priority is None else priority > row.priority
    later = F.lit(False) if row.partition_values is None else (
        values.isNull() | (values < row.partition_values)
    )
    tied = values.eqNullSafe(F.lit(row.partition_values)) & (F.col("id") > row.id)
    return F.coalesce(lower, F.lit(False)) | (
        priority.eqNullSafe(F.lit(row.priority)) & (later | tied)
    )


def next_batch(
    eligible: DataFrame, leases: DataFrame, *, cluster_id: str, worker_id: str, as_of
) -> DataFrame:
    """The first object in work order this worker can lease, and the items with
    the same key that follow it without a break.

    Only two rows reach the driver: the first item and the first item behind it
    that belongs to another object. The batch is a filter between the two.
    """
    eligible = stable(eligible)
    live = leases.where(F.col("expiration_dt") >= moment(as_of))
    others = live.where((F.col("cluster_id") != cluster_id) | (F.col("worker_id") != worker_id))
    taken = others.select(*OBJECT_KEY).withColumnRenamed("object_name", "_actual")
    lockable = eligible.withColumn(
        "_actual", names.actual_object_name(F.col("object_name"), F.col("correlation_data"))
    ).join(taken, ["namespace", "_actual", "usage_code", "file_type"], "left_anti")
    first = lockable.orderBy(*work_order()).select(*eligible.columns).first()
    if first is None:
        return eligible.limit(0)
    same = F.lit(True)
    for name in [*OBJECT_KEY, "wf_type"]:
        same = same & F.col(name).eqNullSafe(F.lit(first[name]))
    stop = eligible.where(_behind(first) & ~same).orderBy(*work_order()).first()
    batch = eligible.where(same & (_behind(first) | (F.col("id") == first.id)))
    return batch if stop is None else batch.where(~_behind(stop))


# Backlog -------------------------------------------------------------------


def backlog(items: DataFrame, log: DataFrame, *, max_attempts: int, stats: bool = False) -> DataFrame:
    """Items never attempted, or failed last with attempts left."""
    tried = with_attempts(items.where(of_class(F.col("wf_type"), stats)), log)
    return tried.where(
        (F.col("attempts") == 0)
        | ((F.col("last_outcome") == "N") & (F.col("attempts") < max_attempts))
    )


def backlog_by_object(items: DataFrame) -> DataFrame:
    return items.groupBy(*OBJECT_KEY).agg(
        F.count(F.lit(1)).alias("items"), F.min("date_created").alias("oldest")
    )


def classified_backlog(
    groups: DataFrame, *, as_of, single_threshold: int, total_threshold: int, age_hours: int
) -> DataFrame:
    """Backlog groups as hot, aged or pooled, and whether each adds a unit.

    Groups go in key order. Only the first aged one adds a unit for its age; the
    others join the pool, which adds one each time it passes the total.
    """
    hot = F.col("items") > single_threshold
    aged = ~hot & workflow.older_than(F.col("oldest"), moment(as_of), age_hours)
    marked = stable(groups.withColumn("_hot", hot).withColumn("_aged", aged))
    first = (
        marked.where("_aged")
        .agg(F.min(F.struct(*OBJECT_KEY)).alias("key"))
        .where("key is not null")
        .select("key.*", F.lit(True).alias("_first"))
    )
    kinds = (
        F.when(F.col("_hot"), "hot").when(F.col("_first"), "aged").otherwise("pooled").alias("kind")
    )
    pool = marked.join(F.broadcast(first), OBJECT_KEY, "left").select(
        *OBJECT_KEY, "items", "oldest", kinds
    )
    weighed = pool.withColumn(
        "_weight", F.when(F.col("kind") == "pooled", F.col("items")).otherwise(0)
    ).withColumn("_keep", F.lit(True))
    numbered = number_runs(
        weighed, [], OBJECT_KEY, "_weight", total_threshold + 1, "object_name", "_keep"
    )
    return numbered.select(
        *OBJECT_KEY,
        "items",
        "oldest",
        "kind",
        ((F.col("kind") != "pooled") | F.col("run_closed")).alias("adds_unit"),
    )


def backlog_sizing(classified: DataFrame, max_units: int) -> DataFrame:
    """Units of capacity the backlog asks for, between one and the maximum."""
    counted = classified.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum(F.col("adds_unit").cast("long")), F.lit(0).cast("long")).alias("added"),
    )
    units = F.col("added") + F.when(F.col("groups") > 1, 1).otherwise(0)
    return counted.select(
        "groups", F.least(F.greatest(units, F.lit(1)), F.lit(max_units)).cast("long").alias("units")
    )


def checkpoint_age(checkpoints: DataFrame, as_of) -> DataFrame:
    """The latest checkpoint and its age in whole minutes."""
    latest = checkpoints.agg(
        F.max(F.struct("id", "processed_dt")).alias("latest")
    ).where("latest is not null")
    return latest.select(
        F.col("latest.id").alias("id"),
        F.timestamp_diff("MINUTE", F.col("latest.processed_dt"), moment(as_of)).alias("age"),
    )


# Items ---------------------------------------------------------------------


def purge_unprocessed(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items to keep and items no processing exists for."""
    off = F.col("wf_type").isin(workflow.NOT_PROCESSED)
    return items.where(~off), items.where(off)


def submitted_by(items: DataFrame, execution_id: str) -> DataFrame:
    return items.where(F.col("execution_id") == execution_id).orderBy("id")


def decoded_items(items: DataFrame) -> DataFrame:
    """Names, decoded partition fields and retry count of each work item."""
    name, correlation = F.col("object_name"), F.col("correlation_data")
    values = F.col("partition_values")
    return items.select(
        "id",
        *OBJECT_KEY,
        "wf_type",
        names.database_name(F.col("namespace")).alias("database_name"),
        names.actual_object_name(name, correlation).alias("actual_object_name"),
        names.table_name(name, F.col("usage_code"), F.col("file_type"), correlation).alias("table_name"),
        "partition_key",
        "partition_values",
        values.contains(partitions.SUB).alias("sub_partition_level"),
        partitions.sub_values(values).alias("sub_values"),
        F.col("id").cast("string").alias("execution_id"),
        F.col("attempts").alias("retries"),
        "cluster_name",
    )


def recorded_outcomes(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The log with the latest outcome of each closed attempt; others stay open."""
    closing = outcomes.groupBy(F.col("log_id").alias("id")).agg(
        F.max(F.struct("end_time", "outcome")).alias("closing")
    )
    return log.join(closing, "id", "left").select(
        "id",
        "notification_id",
        "date_processed",
        F.coalesce(F.col("closing.end_time"), F.col("end_time")).alias("end_time"),
        F.coalesce(F.col("closing.outcome"), F.col("success")).alias("success"),
        "cluster_id",
    )


def retirement(attempted: DataFrame, max_attempts: int) -> DataFrame:
    """What becomes of items just attempted: `outcome` now, `retries` before."""
    done = F.col("outcome") == "Y"
    spent = F.col("retries") >= max_attempts - 1
    return attempted.withColumn(
        "fate",
        F.when(done, "succeeded").when(spent, "exhausted").otherwise("retry"),
    )


def archived(
    items: DataFrame, log: DataFrame, retired: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Kept items, archived items, kept attempts, archived attempts."""
    ids = retired.select("id").distinct()
    of_log = ids.withColumnRenamed("id", "notification_id")
    return (
        items.join(ids, "id", "left_anti"),
        items.join(ids, "id", "left_semi"),
        log.join(of_log, "notification_id", "left_anti"),
        log.join(of_log, "notification_id", "left_semi"),
    )
