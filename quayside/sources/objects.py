"""Scans of registered data: declared columns, several files, values in paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.evolution import under_schema


def spelled_out(mark: str) -> str:
    """The character a registered delimiter stands for: `\\u0001` and `\\001` are both 1."""
    for pattern, base in ((r"\\u([0-9A-Fa-f]+)", 16), (r"\\(\d+)", 10)):
        found = re.fullmatch(pattern, mark)
        if found:
            return chr(int(found.group(1), base))
    return mark


# What stands for an escaped escape and an escaped delimiter; lines that hold them are split by an expression.
_STAND_INS = ("\x01", "\x02")


def _literal(mark: str) -> str:
    """A regular expression that matches `mark` as it is, simple enough to split fast."""
    return "".join("\\" + c if c in ".$|()[]{}^?*+\\" else c for c in mark)


def split_line(line: Column, delimiter: str, escape: str) -> Column:
    """Fields of a line as they are written; an escaped delimiter does not split."""
    plain = F.split(line, _literal(delimiter))
    if not escape:
        return plain
    d, e = _literal(delimiter), _literal(escape)
    # A field behind each delimiter: whatever is escaped, and what is neither escape nor delimiter.
    held = f"{e}(?:{d}|[\\s\\S]|$)"
    free = f"[^{_literal(escape)}{_literal(delimiter[0])}]++"
    rest = f"(?!{d}){_literal(delimiter[0])}|" if len(delimiter) > 1 else ""
    field = f"{d}((?:{free}|{rest}{held})*+)"
    guarded = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(field), F.lit(1))
    if len(delimiter) > 1 or len(escape) > 1 or delimiter == escape or {delimiter, escape} & set(_STAND_INS):
        return F.when(line.contains(escape), guarded).otherwise(plain)
    # Without the expression: escaped pairs, from the left, give way to stand-ins while the line is split.
    marks = list(zip((escape + escape, escape + delimiter), _STAND_INS))
    free_of_marks = ~line.contains(_STAND_INS[0]) & ~line.contains(_STAND_INS[1])
    masked = line
    for pair, mark in marks:
        masked = F.replace(masked, F.lit(pair), F.lit(mark))

    def restored(piece: Column) -> Column:
        for pair, mark in marks:
            piece = F.replace(piece, F.lit(mark), F.lit(pair))
        return piece

    quick = F.transform(F.split(masked, d), restored)
    return F.when(~line.contains(escape), plain).when(free_of_marks, quick).otherwise(guarded)


def field_value(
    piece: Column, kind: T.DataType, delimiter: str, escape: str, null_token: str
) -> Column:
    """A field's value: null if it is the null token as written, else without
    escapes; null as well if it does not fit its type."""
    known = F.nullif(piece, F.lit(null_token))
    if not isinstance(kind, T.StringType):
        return F.trim(known).try_cast(kind)
    if escape:
        shown = F.regexp_replace(known, f"{_literal(escape)}({_literal(delimiter)}|[\\s\\S]|$)", "$1")
        known = F.when(known.contains(escape), shown).otherwise(known)
    return known


def scan_delimited(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType,
    delimiter: str = ",",
    escape: str = "\\",
    null_token: str = "",
    partitions: T.StructType | None = None,
    base_path: str | None = None,
    nested: bool = False,
    path_keys: list[str] | None = None,
) -> DataFrame:
    """Text files, plain or bzip2, under the declared columns.

    Values are not quoted; a value that does not fit its type is null, as are
    columns a line lacks. `partitions` declares columns that folders below
    `base_path` give, and filters on them skip folders. `path_keys` are read out
    of each file's path instead, for versioned folders without a common root.
    """
    folders = partitions or T.StructType()
    reader = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), *folders.fields]))
    if base_path:
        reader = reader.option("basePath", base_path)
    if nested:
        reader = reader.option("recursiveFileLookup", "true")
    read = reader.text(paths)
    separator, mark = spelled_out(delimiter), spelled_out(escape)
    path = F.col("_metadata.file_path")
    from_path = [path_value(path, k).alias(k.lower().replace("-", "_")) for k in path_keys or []]
    # Generated, so that filters on columns don't split each line once more per condition.
    split = read.select(
        F.explode(F.array(split_line(F.col("value"), separator, mark))).alias("_fields"), *folders.fieldNames(), *from_path
    )
    columns = [
        field_value(F.get("_fields", at), f.dataType, separator, mark, null_token).alias(f.name)
        for at, f in enumerate(schema.fields)
    ]
    return split.select(*columns, *split.columns[1:])


def scan_columnar(
    spark: SparkSession,
    paths: str | list[str],
    stored: T.StructType,
    declared: T.StructType | None = None,
    base_path: str | None = None,
    nested: bool = False,
    path_keys: list[str] | None = None,
) -> DataFrame:
    """ORC files; a newer declared schema is applied by position.

    `path_keys` are read out of the paths, behind the columns.
    """
    reader = spark.read.schema(stored)
    if base_path:
        reader = reader.option("basePath", base_path)
    if nested:
        reader = reader.option("recursiveFileLookup", "true")
    read = reader.orc([paths] if isinstance(paths, str) else paths)
    if path_keys:
        path = F.col("_metadata.file_path")
        read = read.select("*", *[path_value(path, k).alias(k.lower().replace("-", "_")) for k in path_keys])
    return read if declared is None else under_schema(read, declared)


def path_value(path: Column, key: str) -> Column:
    """Value of a partition key in a file's path; the folder may spell the key
    in either case and with hyphens, and its characters as `%xx`."""
    spelled = re.escape(key).replace("_", "[-_]")
    found = F.nullif(F.regexp_extract(path, f"(?i)/{spelled}=([^/]+)", 1), F.lit(""))
    # The path spells what the folder's name holds, and that name what the value holds.
    return unescaped(unescaped(found))


def unescaped(text: Column) -> Column:
    """`%xx` as characters, where they are any; a plus stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def on_dates(df: DataFrame, date_column: str, partition_column: str | None, dates: list[str]) -> DataFrame:
    """Rows of the given dates.

    If the object declares its partition column equal to the date, the same
    condition on that column lets the scan skip the other partitions.
    """
    wanted = df.where(F.col(date_column).isin([F.lit(d).cast("date") for d in dates]))
    return wanted if partition_column is None else wanted.where(F.col(partition_column).isin(dates))
