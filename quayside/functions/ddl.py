"""Types, delimiters and columns read out of table definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"(?i)^\s*DECIMAL\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)"


def decimal_precision(type_text: Column) -> Column:
    """Precision of a decimal type; a bare one has ten digits."""
    return F.coalesce(F.regexp_extract(type_text, _DECIMAL, 1).try_cast("int"), F.lit(10))


def decimal_scale(type_text: Column) -> Column:
    return F.coalesce(F.regexp_extract(type_text, _DECIMAL, 2).try_cast("int"), F.lit(0))


def same_type(left: Column, right: Column) -> Column:
    decimals = F.upper(left).startswith("DECIMAL") & F.upper(right).startswith("DECIMAL")
    return (F.upper(left) == F.upper(right)) | (
        decimals
        & (decimal_precision(left) == decimal_precision(right))
        & (decimal_scale(left) == decimal_scale(right))
    )


def same_column(left_name: Column, left_type: Column, right_name: Column, right_type: Column) -> Column:
    return (F.lower(left_name) == F.lower(right_name)) & same_type(left_type, right_type)


def character_code(text: Column) -> Column:
    """Code of a `\\uXXXX` (hexadecimal) or `\\NNN` (read as decimal) escape."""
    digits = F.substr(text, F.lit(3))
    hexadecimal = F.when(digits.rlike("^[0-9A-Fa-f]+$"), F.conv(digits, 16, 10).try_cast("int"))
    return F.when(text.startswith("\\u"), hexadecimal).when(
        text.startswith("\\"), F.substr(text, F.lit(2)).try_cast("int")
    )


def same_character(left: Column, right: Column) -> Column:
    codes = F.coalesce(character_code(left) == character_code(right), F.lit(False))
    return F.when(left == right, F.lit(True)).otherwise(codes)


def _columns(body: Column, separator: str) -> Column:
    """Column definitions of a comma-and-newline list; short lines are dropped."""

    def entry(line: Column) -> Column:
        words = F.split(F.translate(F.regexp_replace(line, r"^\s+|\s+$", ""), "`", ""), " ")
        third = F.get(words, 2)
        glued = F.when(
            (F.size(words) > 2) & (F.upper(third) != "COMMENT"),
            F.concat(F.get(words, 1), F.trim(third)),
        ).otherwise(F.get(words, 1))
        return F.struct(
            F.get(words, 0).alias("name"), glued.alias("type"), F.size(words).alias("words")
        )

    kept = F.filter(F.transform(F.split(body, separator), entry), lambda e: e["words"] >= 2)
    return F.transform(
        kept,
        lambda e, i: F.struct(i.alias("ordinal"), e["name"].alias("name"), e["type"].alias("type")),
    )


def table_columns(ddl: Column) -> Column:
    """Data columns in front of the partition clause; null where there is none."""
    front = F.substring_index(ddl, "PARTITIONED BY", 1)
    body = F.regexp_extract(front, r"(?s)\((.*)\)", 1)
    return F.when(ddl.contains("PARTITIONED BY") & (body != ""), _columns(body, ",\n"))


def partition_columns(ddl: Column) -> Column:
    """Columns between the partition clause and the row format; null without both."""
    clause = F.regexp_extract(ddl, r"(?s)PARTITIONED BY(.*?)ROW FORMAT", 1)
    body = F.regexp_extract(clause, r"(?s)\((.*)\)", 1)
    split = F.when(body.contains("\n"), _columns(body, ",\n")).otherwise(_columns(body, ", `"))
    return F.when(clause != "", split)


def parses(ddl: Column) -> Column:
    """Whether both column lists can be read from the definition."""
    return table_columns(ddl).isNotNull() & partition_columns(ddl).isNotNull()


def _setting(ddl: Column, clause: str, prop: str) -> Column:
    by_clause = F.regexp_extract(ddl, f"(?s){clause}[^']*'([^']*)'", 1)
    by_property = F.regexp_extract(ddl, f"(?s)'{prop}'.*?='([^']*)'", 1)
    return F.when(ddl.contains(clause), by_clause).otherwise(by_property)


def field_delimiter(ddl: Column) -> Column:
    return _setting(ddl, "FIELDS TERMINATED BY", "field.delim")


def escape_character(ddl: Column) -> Column:
    return _setting(ddl, "ESCAPED BY", "escape.delim")


def null_token(ddl: Column) -> Column:
    return _setting(ddl, "NULL DEFINED AS", "serialization.null.format")
