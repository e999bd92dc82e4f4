"""Schema comparison by position, change plans, and reading under a new schema.

Columns come as rows: `table_name`, `is_partition`, `ordinal`, `name`, `type`.
Statements and reports are one text per table; their size is a table's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions import ddl
from quayside.functions.workflow import SINGLETON

TABLE = ["table_name"]


def aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new columns side by side by table, kind and position."""
    keys = ["table_name", "is_partition", "ordinal"]
    before = old.select(*keys, F.col("name").alias("old_name"), F.col("type").alias("old_type"))
    after = new.select(*keys, F.col("name").alias("new_name"), F.col("type").alias("new_type"))
    return before.join(after, keys, "full")


def column_changes(old: DataFrame, new: DataFrame, report_dropped: bool = False) -> DataFrame:
    """Each changed data column: a new name hides a new type; a column the new
    schema no longer has is reported only on request."""
    renamed = F.lower("new_name") != F.lower("old_name")
    change = (
        F.when(F.col("old_name").isNull(), "added")
        .when(F.col("new_name").isNull(), "dropped")
        .when(renamed, "name")
        .when(~ddl.same_type(F.col("new_type"), F.col("old_type")), "type")
    )
    changed = (
        aligned(old, new)
        .where(~F.col("is_partition"))
        .drop("is_partition")
        .withColumn("change", change)
        .where("change is not null")
    )
    return changed if report_dropped else changed.where("change <> 'dropped'")


def partition_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per table, whether its partition columns differ in number, name or type."""
    same = ddl.same_column(
        F.col("old_name"), F.col("old_type"), F.col("new_name"), F.col("new_type")
    )
    return (
        aligned(old, new)
        .where("is_partition")
        .groupBy("table_name")
        .agg(F.bool_or(~F.coalesce(same, F.lit(False))).alias("partition_changed"))
    )


def change_flags(tables: DataFrame, changes: DataFrame, partition_flags: DataFrame) -> DataFrame:
    """Per table: has it column changes, partition changes, any change."""
    columns = changes.groupBy("table_name").agg(F.lit(True).alias("_c"))
    return (
        tables.select("table_name")
        .join(columns, "table_name", "left")
        .join(partition_flags, "table_name", "left")
        .select(
            "table_name",
            F.coalesce("_c", F.lit(False)).alias("column_changed"),
            F.coalesce("partition_changed", F.lit(False)).alias("partition_changed"),
        )
        .withColumn("changed", F.col("column_changed") | F.col("partition_changed"))
    )


def _listed(entry: Column, when: Column | None = None) -> Column:
    """Entries of a table in column order, as one array."""
    item = F.struct(F.col("ordinal"), entry.alias("text"))
    items = F.array_sort(F.collect_list(item if when is None else F.when(when, item)))
    return F.transform(items, lambda i: i["text"])


def replacements(new: DataFrame, cascade: bool = True) -> DataFrame:
    """A statement per table that replaces all its data columns."""
    listed = F.array_join(_listed(F.format_string("`%s` %s", F.col("name"), F.col("type"))), ", ")
    tail = F.lit(") CASCADE;" if cascade else ");")
    return (
        new.where(~F.col("is_partition"))
        .groupBy("table_name")
        .agg(listed.alias("_columns"))
        .select(
            "table_name",
            F.concat(
                F.lit("ALTER TABLE `"), "table_name", F.lit("` REPLACE COLUMNS ("), "_columns", tail
            ).alias("statement"),
        )
    )


def uncomparable(definitions: DataFrame) -> DataFrame:
    """Tables whose stored definition (`ddl`) cannot be read, so that nothing can be compared."""
    return definitions.where(~F.coalesce(ddl.parses(F.col("ddl")), F.lit(False))).select("table_name").distinct()


def change_plan(
    tables: DataFrame, changes: DataFrame, new: DataFrame, uncompared: DataFrame | None = None
) -> DataFrame:
    """Statements per table, to be run by `step`, then `ordinal`.

    Of tables in `uncompared` only text tables can be replaced, without cascade.

    `tables` has `table_name`, `file_type`, `wf_type`, `partition_key`. Columnar
    tables rename, retype, then add; other tables replace all columns. An
    unpartitioned singleton is always replaced.
    """
    whole = (F.col("wf_type") == SINGLETON) & (F.lower("partition_key") == "partition")
    kinds = tables.select(
        "table_name",
        F.when(whole, "whole").when(F.upper("file_type") == "ORC", "columns").otherwise("text").alias("kind"),
    )
    broken = None
    if uncompared is not None:
        broken = kinds.where("kind = 'text'").select("table_name").join(uncompared, "table_name", "left_semi")
        kinds = kinds.join(uncompared.select("table_name", F.lit(True).alias("_broken")), "table_name", "left").where(
            "_broken is null or kind = 'whole'"
        ).drop("_broken")
    columnar = changes.join(kinds.where("kind = 'columns'").select("table_name"), "table_name")
    single = columnar.where("change in ('name', 'type')").select(
        "table_name",
        F.when(F.col("change") == "name", 1).otherwise(2).alias("step"),
        "ordinal",
        F.format_string(
            "Alter table %s change %s %s %s CASCADE;",
            F.col("table_name"), F.col("old_name"), F.col("new_name"), F.col("new_type"),
        ).alias("statement"),
    )
    added = (
        columnar.where("change = 'added'")
        .groupBy("table_name")
        .agg(
            F.min("ordinal").alias("ordinal"),
            F.array_join(
                _listed(F.format_string("%s %s", F.col("new_name"), F.col("new_type"))), ","
            ).alias("_columns"),
        )
        .select(
            "table_name",
            F.lit(3).alias("step"),
            "ordinal",
            F.format_string(
                "Alter table %s add columns (%s) CASCADE;", F.col("table_name"), F.col("_columns")
            ).alias("statement"),
        )
    )
    changed = changes.select("table_name").distinct()
    textual = kinds.where("kind = 'text'").select("table_name").join(changed, "table_name", "left_semi")
    always = kinds.where("kind = 'whole'").select("table_name")

    def replaced(which: DataFrame, cascade: bool) -> DataFrame:
        return which.join(replacements(new, cascade), "table_name").select(
            "table_name", F.lit(1).alias("step"), F.lit(0).alias("ordinal"), "statement"
        )

    planned = (
        single.unionByName(added)
        .unionByName(replaced(textual, True))
        .unionByName(replaced(always, False))
    )
    return planned if broken is None else planned.unionByName(replaced(broken, False))


def format_changes(old: DataFrame, new: DataFrame, detect: bool = False) -> DataFrame:
    """Per table, whether delimiter, escape or null token differ; off by default."""
    marks = ["delimiter", "escape", "null_token"]
    after = new.select("table_name", *[F.col(m).alias(f"new_{m}") for m in marks])

    def differs(mark: str) -> Column:
        return ~ddl.same_character(F.col(mark), F.col(f"new_{mark}")) if detect else F.lit(False)

    return old.join(after, "table_name").select(
        "table_name", *[differs(m).alias(f"{m}_changed") for m in marks]
    )


# What a change report says of each mark.
MARK_TITLES = {"delimiter": "Delimiter", "escape": "Escape Character", "null_token": "Null Character"}


def mark_lines(old: DataFrame, new: DataFrame, detect: bool = True) -> DataFrame:
    """A line per table and changed mark, as `delimiter`, `escape` and `null_token`; null where it is the same."""
    after = new.select("table_name", *[F.col(m).alias(f"new_{m}") for m in MARK_TITLES])
    both = old.join(after, "table_name").join(format_changes(old, new, detect), "table_name")
    return both.select("table_name", *[
        F.when(
            F.col(f"{m}_changed"),
            F.format_string(f"{title} Change, Existing: '%s', New: '%s'", F.col(m), F.col(f"new_{m}")),
        ).alias(m)
        for m, title in MARK_TITLES.items()
    ])


def change_reports(
    tables: DataFrame, changes: DataFrame, old: DataFrame, new: DataFrame, partition_flags: DataFrame,
    marks: DataFrame | None = None, definitions: DataFrame | None = None,
) -> DataFrame:
    """A text per changed table. `tables` has `namespace`, `table_name`, `format_version`.

    `marks` is what `mark_lines` gives; `definitions` has `old_ddl` and `new_ddl`.
    """

    def shown(side: str) -> Column:
        return F.format_string(
            "%d -> %s(%s)", F.col("ordinal"), F.col(f"{side}_name"), F.col(f"{side}_type")
        )

    kind = F.col("change")
    renamed = F.concat(F.lit("  From "), shown("old"), F.lit(" to "), shown("new"))
    retyped = F.format_string(
        "    %d %s: From %s to %s",
        F.col("ordinal"), F.col("old_name"), F.col("old_type"), F.col("new_type"),
    )
    added = F.concat(F.lit("    "), shown("new"))
    sections = changes.groupBy("table_name").agg(
        _listed(renamed, kind == "name").alias("_names"),
        _listed(retyped, kind == "type").alias("_types"),
        _listed(added, kind == "added").alias("_added"),
    )
    entry = F.format_string("\t\t%d -> %s(%s)", F.col("ordinal"), F.col("name"), F.col("type"))

    def keys(side: DataFrame, name: str) -> DataFrame:
        return side.where("is_partition").groupBy("table_name").agg(_listed(entry).alias(name))

    moved = partition_flags.where("partition_changed").select("table_name")
    moved = moved.join(keys(old, "_old"), "table_name", "left").join(
        keys(new, "_new"), "table_name", "left"
    )
    both = sections.join(moved.withColumn("_moved", F.lit(True)), "table_name", "full")

    def section(title: str, lines: str) -> Column:
        return F.when(
            F.size(lines) > 0, F.concat(F.lit(title + "\n"), F.array_join(lines, "\n"))
        )

    def joined(lines: str) -> Column:
        return F.coalesce(F.array_join(lines, "\n"), F.lit(""))

    partition_part = F.when(
        F.col("_moved"),
        F.concat(
            F.lit("Partition Column Change:\n\tExisting Partition Column(s):\n"), joined("_old"),
            F.lit("\n\tNew Partition Column(s):\n"), joined("_new"),
        ),
    )
    head = F.format_string(
        "Namespace: %s  Table Name: %s   Format Version from Data Management: %d",
        F.col("namespace"), F.col("table_name"), F.col("format_version"),
    )
    more = []
    if marks is not None:
        named = marks.where(" or ".join(f"{m} is not null" for m in MARK_TITLES))
        both = both.join(named.select("table_name", *[F.col(m).alias(f"_{m}") for m in MARK_TITLES]), "table_name", "full")
        more += [F.col(f"_{m}") for m in MARK_TITLES]
    reported = tables.join(both, "table_name")
    if definitions is not None:
        reported = reported.join(
            definitions.select("table_name", F.col("old_ddl").alias("_old_ddl"), F.col("new_ddl").alias("_new_ddl")),
            "table_name", "left",
        )
        more += [F.concat(F.lit("Existing Schema:\n\n   "), "_old_ddl"), F.concat(F.lit("New Schema:\n\n"), "_new_ddl")]
    # The report's titles.
    return reported.select(
        "table_name",
        F.concat_ws(
            "\n\n",
            head,
            section("Column Name Changes:", "_names"),
            section("Column Type Changes:", "_types"),
            section("New Columns:", "_added"),
            partition_part,
            *more,
        ).alias("report"),
    )


def under_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by position under the names and types of `schema`.

    Columns the data lacks are null; columns the schema lacks are left out.
    """
    have = df.columns
    columns = []
    for at, field in enumerate(schema.fields):
        value = F.col(f"`{have[at]}`") if at < len(have) else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
