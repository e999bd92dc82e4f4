"""Registered data, partitions, back-loads and statistics requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import partitions as pv
from quayside.functions import workflow
from quayside.functions.names import OBJECT_KEY
from quayside.operators import spans
from quayside.operators.asof import as_of_join
from quayside.operators.runs import number_runs
from quayside.session import stable

PARTITION = [*OBJECT_KEY, "partition_value"]

# Execution ids of requests the system itself submits.
BY_LOAD = "SUBMITTED_BY_JOB_PROCESSOR"
BY_BACK_LOAD = "SUBMITTED_BY_BACKLOADING"


def latest_valid(data: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """The newest valid version of each partition, by format then data version; of several the greatest file path.

    A ranking of which only the first is kept: Spark drops the others in each task
    before the shuffle, so one exchange carries at most a row per partition and task,
    however many versions a partition has.
    """
    keys = parts or [*PARTITION, "sub_partition_values"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("format_version"), F.desc("data_version"), F.desc("file_path"))
    ranked = data.where(F.col("status") == "VALID").withColumn("_rank", F.row_number().over(newest))
    return ranked.where("_rank = 1").select(*data.columns)


def latest_before(data: DataFrame, as_of_date: Column, keys: list[str] | None = None) -> DataFrame:
    """Greatest partition value up to and including tomorrow, per object."""
    limit = F.date_add(as_of_date, 1).cast("string")
    return (
        data.where(F.col("partition_value") <= limit)
        .groupBy(*(keys or OBJECT_KEY))
        .agg(F.max("partition_value").alias("partition_value"))
    )


def latest_at(items: DataFrame, data: DataFrame, created: Column, keys: list[str] | None = None) -> DataFrame:
    """`items` with `latest_value` and `latest_path`: the greatest partition value of their object up to and
    including the day behind their own creation; of its files the greatest path. Null where there is none."""
    entries = data.select(*(keys or OBJECT_KEY), F.col("partition_value").alias("latest_value"), F.col("file_path").alias("latest_path"))
    limit = F.date_add(created.cast("date"), 1).cast("string")
    return as_of_join(items, entries, keys or OBJECT_KEY, limit, F.col("latest_value"), ["latest_value", "latest_path"])


def sub_partition_union(data: DataFrame) -> DataFrame:
    """Distinct sub-partition values of each partition, one row each.

    A partition without sub-partitions keeps one row with a null value.
    """
    exploded = data.select(*PARTITION, F.explode_outer("sub_partition_values").alias("sub_value"))
    return exploded.distinct()


def partition_weights(data: DataFrame) -> DataFrame:
    """Each partition with one plus the number of its distinct sub-partition values."""
    return (
        sub_partition_union(data)
        .groupBy(*PARTITION)
        .agg((F.count("sub_value") + 1).alias("weight"))
    )


def weighted_chunks(
    weights: DataFrame, chunk_size: int, group: list[str] | None = None, keep: str | None = None
) -> DataFrame:
    """Number partitions, in string order, into chunks of at least `chunk_size`."""
    kept = weights.withColumn("kept", F.lit(True)) if keep is None else weights
    numbered = number_runs(
        kept, group or OBJECT_KEY, ["partition_value"], "weight", chunk_size,
        "partition_value", keep or "kept",
    )
    return numbered.withColumnRenamed("run_no", "chunk_no").drop("run_closed")


def encoded_chunks(chunks: DataFrame, group: list[str], is_date: str) -> DataFrame:
    """Each chunk as the partition values of a work item.

    A date chunk is `last__start`; it starts at its first value if it is the
    first, else at the last value of the chunk in front, so ranges overlap. Any
    other chunk is a descending list. Every row weighs at least one, so a chunk
    has no more rows than the chunk size.
    """
    value = F.col("partition_value")
    packed = (
        chunks.where("kept")
        .groupBy(*group, is_date, "chunk_no")
        .agg(
            F.min(F.struct("partition_value", "previous")).alias("first"),
            F.max("partition_value").alias("last"),
            F.sort_array(F.collect_list(F.when(~F.col(is_date), value)), asc=False).alias("listed"),
        )
    )
    start = F.coalesce(F.col("first.previous"), F.col("first.partition_value"))
    return packed.select(
        *group,
        "chunk_no",
        F.when(F.col(is_date), F.concat(F.col("last"), F.lit(pv.RANGE), start))
        .otherwise(F.array_join("listed", ","))
        .alias("partition_values"),
    )


def submitted_values(items: DataFrame, strict: bool = False) -> DataFrame:
    """Partition values already requested under each execution id.

    Lists count by item and ranges by their two ends; single values do not
    count. `strict` counts every day of a range and single values as well.
    """
    values = F.col("partition_values")
    members = (
        F.when(values.contains(pv.LIST), F.split(values, pv.LIST))
        .when(values.contains(pv.RANGE), F.split(values, pv.RANGE))
    )
    if strict:
        members = pv.expanded_values(values)
    return items.select(
        "execution_id", F.explode(members).alias("partition_value")
    ).distinct()


def with_submitted(chunks: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    """`chunks` with `seen`: whether their partition value was requested under their execution id.

    `strict` asks whether a requested span covers its day, without spelling out days;
    values that are no dates must be equal.
    """
    if strict:
        key = ["execution_id"]
        day = F.col("partition_value").try_cast("date")
        chunks = spans.inside(chunks, day, spans.value_spans(items, key), key, "_covered")
        values = spans.other_values(items, key).distinct()
    else:
        chunks, values = chunks.withColumn("_covered", F.lit(False)), submitted_values(items)
    found = chunks.join(values.withColumn("_named", F.lit(True)), ["execution_id", "partition_value"], "left")
    return found.withColumn("seen", F.col("_covered") | F.coalesce("_named", F.lit(False))).drop("_covered", "_named")


def without_submitted(chunks: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    return with_submitted(chunks, items, strict).where("not seen").drop("seen")


def already_submitted(chunks: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    return with_submitted(chunks, items, strict).where("seen").drop("seen")


def submitted_spans(items: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Per `keys`, what items ask for as spans of days: `submitted`, `overlapping` where several do, and
    `missing`, the days of `available` (`keys`, `partition_value`) that none asks for."""
    asked = spans.value_spans(items, keys)
    day = F.col("partition_value").try_cast("date")
    days = available.select(*keys, day.alias("first_day"), day.alias("last_day")).distinct()
    kinds = {"submitted": spans.covered(asked, keys), "overlapping": spans.covered(asked, keys, 2), "missing": spans.without(days, asked, keys)}
    found = None
    for kind, rows in kinds.items():
        rows = rows.select(*keys, F.lit(kind).alias("kind"), *spans.SPAN)
        found = rows if found is None else found.unionByName(rows)
    return found


def back_load_plan(
    requests: DataFrame,
    data: DataFrame,
    items: DataFrame,
    date_keyed: DataFrame,
    chunk_size: int,
    strict: bool = False,
) -> DataFrame:
    """Work items that load every available partition of the requested objects.

    `requests` are back-load items, `date_keyed` says per object whether its
    partition key is a date. An object without partitions gives one row with
    chunk null, so that it can be reported.
    """
    # Requests are few and are met five times.
    wanted = stable(requests.select(
        *OBJECT_KEY,
        F.col("id").cast("string").alias("execution_id"),
        "partition_key",
        "correlation_data",
        "cluster_name",
    ))
    # A partition and its sub-partitions are there if any version is valid; which one is newest changes no weight.
    valid = data.where("status = 'VALID'").select(*PARTITION, "sub_partition_values")
    available = stable(partition_weights(valid.join(wanted, OBJECT_KEY, "left_semi")))
    weighed = available.join(wanted.select(*OBJECT_KEY, "execution_id"), OBJECT_KEY).join(
        date_keyed, OBJECT_KEY, "left"
    )
    # Written, as the ranges that chunks are cut in are sampled from it first.
    flagged = stable(with_submitted(weighed, items, strict).select(
        *OBJECT_KEY,
        "execution_id",
        "partition_value",
        "weight",
        F.coalesce("is_date", F.lit(False)).alias("is_date"),
        (~F.col("seen")).alias("kept"),
    ))
    group = [*OBJECT_KEY, "execution_id"]
    chunks = weighted_chunks(flagged, chunk_size, group, keep="kept")
    encoded = encoded_chunks(chunks, group, "is_date")
    planned = wanted.join(encoded, group, "inner")
    none = wanted.join(available.select(*OBJECT_KEY).distinct(), OBJECT_KEY, "left_anti")
    return planned.unionByName(none, allowMissingColumns=True).withColumn(
        "wf_type", F.lit(workflow.MANAGED)
    )


# Loading -------------------------------------------------------------------


def requested_partitions(items: DataFrame) -> DataFrame:
    """One row per partition value a work item asks for."""
    return items.select("*", F.explode(pv.expanded_values(F.col("partition_values"))).alias("wanted_value"))


def selection_rule(wf_type: Column, partition_key: Column, values: Column) -> Column:
    """How the partitions of a work item are looked up."""
    return (
        F.when(workflow.is_partitioned_singleton(wf_type, partition_key), "latest")
        .when(workflow.is_unpartitioned_singleton(wf_type, partition_key), "none")
        .when(values.contains(pv.SUB), "sub-partitions")
        .otherwise("values")
    )


def _ruled(items: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Work items with the rule that looks up their partitions."""
    rule = selection_rule(F.col("wf_type"), F.col("partition_key"), F.col("partition_values"))
    return items.withColumn("rule", rule).select(
        "id", *OBJECT_KEY, "rule", "partition_values", F.struct(F.lit(0), *(carry or [])).alias("_carried")
    )


def _named(ruled: DataFrame) -> DataFrame:
    """Partition values that items name, with a leading part of the sub-partition values as `_path`."""
    given = pv.sub_values(F.col("partition_values"))
    nested = F.col("rule") == "sub-partitions"
    values = (
        F.when(nested, F.array(F.get(given, 0)))
        .when(F.col("rule") == "none", F.array(F.lit(pv.UNPARTITIONED_VALUE)))
        .otherwise(F.array_distinct(pv.expanded_values(F.col("partition_values"))))
    )
    path = F.array_join(F.slice(given, 2, F.greatest(F.size(given) - 1, F.lit(0))), ":")
    return ruled.where("rule <> 'latest'").select(
        "id",
        *OBJECT_KEY,
        "rule",
        F.explode(values).alias("partition_value"),
        F.when(nested, path).otherwise(F.lit("")).alias("_path"),
        "_carried",
    )


def _findable(base: DataFrame) -> DataFrame:
    """Partitions under every leading part of their sub-partition values.

    Fewer values than levels select every partition below them.
    """
    subs = F.coalesce("sub_partition_values", F.array().cast("array<string>"))
    leading = F.transform(F.sequence(F.lit(0), F.size(subs)), lambda n: F.array_join(F.slice(subs, 1, n), ":"))
    return base.withColumn("_path", F.explode(leading))


def unavailable_partitions(items: DataFrame, data: DataFrame) -> DataFrame:
    """`id`, `rule` and `partition_value` of what items name and no registered data has; sub-partitions behind a colon."""
    wanted = _named(_ruled(items))
    lacking = wanted.join(_findable(data.select(*PARTITION, "sub_partition_values")), [*PARTITION, "_path"], "left_anti")
    value = F.when(F.col("_path") == "", F.col("partition_value")).otherwise(F.concat_ws(":", "partition_value", "_path"))
    return lacking.select("id", "rule", value.alias("partition_value"))


def selected_partitions(
    items: DataFrame, data: DataFrame, as_of_date: Column, carry: list[str] | None = None
) -> DataFrame:
    """Registered partitions each work item adds, by its selection rule, with its columns `carry`.

    `data` holds the latest valid partitions. Every rule comes down to partition
    values and a leading part of the sub-partition values, so one equi-join
    serves all and no rule turns into a scan over all pairs of an object.
    """
    ruled, base = _ruled(items, carry), data.select(*PARTITION, "sub_partition_values", "file_path")
    named, singletons = _named(ruled), ruled.where("rule = 'latest'")
    newest = latest_before(base.join(singletons, OBJECT_KEY, "left_semi"), as_of_date)
    latest = singletons.join(newest, OBJECT_KEY).withColumn("_path", F.lit(""))
    wanted = named.unionByName(latest.select(*named.columns))
    found = wanted.join(_findable(base), [*PARTITION, "_path"])
    return found.select(
        "id", *PARTITION, "rule", "sub_partition_values", "file_path", *[F.col(f"_carried.{c}").alias(c) for c in carry or []]
    )


def added_partitions(existing: DataFrame, requested: DataFrame) -> DataFrame:
    """The partition table after dropping and adding the requested partitions.

    Both have `table_name`, `part_name` and `location`; a partition requested
    twice takes the greatest location, so that a repeat changes nothing.
    """
    fresh = stable(requested.groupBy("table_name", "part_name").agg(F.max("location").alias("location")))
    kept = existing.join(fresh, ["table_name", "part_name"], "left_anti")
    return kept.select("table_name", "part_name", "location").unionByName(fresh)


def refreshed_singletons(existing: DataFrame, latest: DataFrame) -> DataFrame:
    """The partition table after singletons drop their dated partitions and add
    the latest one. `latest` has `table_name`, `partition_value`, `part_name`,
    `location`; `existing` has `partition_value` too."""
    # Met three times.
    latest = stable(latest)
    tables = latest.select("table_name").distinct()
    dated = existing.where(F.col("partition_value") > "1970-01-01")
    dropped = dated.join(tables, "table_name", "left_semi").select("table_name", "part_name").distinct()
    kept = existing.join(dropped, ["table_name", "part_name"], "left_anti")
    kept = kept.join(latest, ["table_name", "part_name"], "left_anti")
    columns = ["table_name", "partition_value", "part_name", "location"]
    return kept.select(*columns).unionByName(latest.select(*columns))


def repointed_tables(tables: DataFrame, locations: DataFrame) -> DataFrame:
    """Unpartitioned tables with the location of their newest data."""
    fresh = locations.select("table_name", F.col("location").alias("_new"))
    return tables.join(fresh, "table_name", "left").select(
        *[c for c in tables.columns if c != "location"],
        F.coalesce("_new", "location").alias("location"),
    )


def existing_partitions(parts: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """Partitions of all tables, or those that match a partial spec.

    `specs` has `table_name` and `spec` such as `k=v/k2=v2` over leading keys.
    A match is an equality on the leading part of the name.
    """
    if specs is None:
        return parts
    pieces = F.split("part_name", "/")
    leading = F.transform(
        F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), "/")
    )
    opened = parts.withColumn("spec", F.explode(leading))
    return opened.join(specs.select("table_name", "spec").distinct(), ["table_name", "spec"], "left_semi").drop("spec").distinct()


def partition_diff(registered: DataFrame, existing: DataFrame) -> DataFrame:
    """Registered against existing partitions by canonical name."""
    old = existing.select("table_name", "part_name", F.col("location").alias("old_location"))
    both = registered.select("table_name", "part_name", "location").join(
        old, ["table_name", "part_name"], "full"
    )
    return both.withColumn(
        "change",
        F.when(F.col("old_location").isNull(), "add")
        .when(F.col("location").isNull(), "unregistered")
        .when(F.col("location") != F.col("old_location"), "move")
        .otherwise("same"),
    )


# Statistics requests -------------------------------------------------------


def stats_requests(items: DataFrame) -> DataFrame:
    """One statistics item per partition value a load has added.

    `items` may carry `key_values`, the map of sub-partition keys to values.
    """
    expanded = pv.expanded_values(F.col("partition_values"))
    single = F.size(expanded) == 1
    adjusted = pv.stats_values(
        F.col("key_values"), F.col("wf_type"), F.col("partition_key"), F.col("_value")
    )
    return (
        items.withColumn("_single", single)
        .withColumn("_value", F.explode(expanded))
        .select(
            *OBJECT_KEY,
            F.lit(workflow.STATS).alias("wf_type"),
            F.lit(BY_LOAD).alias("execution_id"),
            pv.stats_keys(F.col("key_values"), F.col("partition_key")).alias("partition_key"),
            F.when(F.col("_single"), adjusted).otherwise(F.col("_value")).alias("partition_values"),
            "correlation_data",
            "cluster_name",
        )
    )


def full_stats_requests(items: DataFrame, partition_names: str = "partition_names") -> DataFrame:
    """A statistics item over all partitions of an object."""
    return items.select(
        *OBJECT_KEY,
        F.lit(workflow.STATS).alias("wf_type"),
        F.lit(BY_BACK_LOAD).alias("execution_id"),
        pv.quoted_keys(F.col(partition_names)).alias("partition_key"),
        F.lit("").alias("partition_values"),
    )


def manual_back_loads(
    name_lists: DataFrame, registrations: DataFrame, as_of_date: Column
) -> DataFrame:
    """Work items for named registrations; an unknown name or job gives none.

    `name_lists` has `names`, a comma list, and `partition_value`.
    """
    asked = name_lists.select(
        F.explode(F.split("names", ",")).alias("notification_name"), "partition_value"
    )
    code = workflow.code_for_job(F.col("job_name"), F.col("partition_value"))
    singleton = code == workflow.SINGLETON
    keyed = F.when(
        singleton & (F.coalesce("partition_key", F.lit("")) == ""), F.lit(pv.UNPARTITIONED_VALUE)
    ).otherwise(F.col("partition_key"))
    return (
        asked.join(registrations, "notification_name")
        .withColumn("wf_type", code)
        .where(F.col("wf_type").isNotNull())
        .select(
            "notification_name",
            *OBJECT_KEY,
            "wf_type",
            F.when(F.col("wf_type") == workflow.BACK_LOAD, F.lit("")).otherwise(keyed).alias("partition_key"),
            F.when(singleton, as_of_date.cast("string"))
            .when(F.col("wf_type") == workflow.MANAGED, F.col("partition_value"))
            .otherwise(F.lit(""))
            .alias("partition_values"),
            "correlation_data",
        )
    )
