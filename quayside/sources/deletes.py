"""Rows deleted from file tables by writing anew only the files that hold some.

Spark's own file tables have no DELETE. The files that hold rows to delete are found
first; what stays of them is written to a folder of its own that readers skip. A
journal then names both sides, and only after it is there do the new files take the
place of the old ones. If the session ends in between, `finish_deletes` carries the
journal out; without a journal nothing has changed. Other files and partitions are
neither read a second time nor moved, and the table and its partitions keep their
places.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.partitions import quoted
from quayside.session import stable

STAGED = "_rows-"
JOURNAL = "_journal.json"
_PATH, _FOLDER = "stored_in_path", "stored_in_folder"


@dataclass(frozen=True)
class Deleted:
    """Rows deleted, files that held some, files written for what stays of them, partitions dropped."""

    rows: int
    files: int
    written: int
    partitions: int


class _Files:
    """The file systems of a session."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, uri: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.jvm.java.net.URI(uri))

    def below(self, folder, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(folder, name)

    def system(self, path):
        return path.getFileSystem(self.conf)

    def listed(self, folder) -> list:
        fs = self.system(folder)
        return list(fs.listStatus(folder)) if fs.exists(folder) else []

    def move(self, source, target) -> None:
        """Nothing to do if a move has happened already."""
        one, other = self.system(source), self.system(target)
        if not one.exists(source):
            return
        if one.getUri().equals(other.getUri()):
            one.rename(source, target)
        else:
            self.jvm.org.apache.hadoop.fs.FileUtil.copy(one, source, other, target, True, True, self.conf)

    def remove(self, path, recursive: bool = False) -> None:
        self.system(path).delete(path, recursive)

    def write(self, path, text: str) -> None:
        """The whole text or nothing, as it takes its name last."""
        part = self.jvm.org.apache.hadoop.fs.Path(path.toString() + ".part")
        out = self.system(part).create(part, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        self.system(part).rename(part, path)

    def read(self, path) -> str | None:
        fs = self.system(path)
        if not fs.exists(path):
            return None
        source = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()


def _described(spark: SparkSession, table: str) -> dict:
    return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {table} AS JSON").first()[0])


def _partition_spec(by: list[str]) -> Column:
    """The partition of a row as a specification; a null value has a spelling of its own."""
    pieces = [F.concat(F.lit(f"`{c}`="), F.coalesce(quoted(F.col(f"`{c}`").cast("string")), F.lit("NULL"))) for c in by]
    return F.concat_ws(", ", *pieces) if by else F.lit("")


def touched_files(spark: SparkSession, table: str, gone: Column) -> DataFrame:
    """Files of a table that hold rows to delete: `path`, `folder`, `rows`, the partition's columns and its `spec`."""
    by = _described(spark, table).get("partition_columns", [])
    held = spark.table(table).where(gone).select(F.col("_metadata.file_path").alias("path"), *[F.col(f"`{c}`") for c in by])
    counted = held.groupBy("path", *[F.col(f"`{c}`") for c in by]).agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("spec", _partition_spec(by)).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))


def delete_rows(spark: SparkSession, table: str, gone: Column) -> Deleted:
    """Delete the rows for which `gone` is true.

    Format, options and partition columns are those of the catalog. A partition that
    has become empty is dropped. What goes to the driver is one line per touched file.
    One delete at a time may run on a table.
    A reader that began before may fail on a file that is gone, and one that lists files
    in the moment of the change may meet some rows twice; so no reader loses rows.
    """
    finish_deletes(spark, table)
    known = _described(spark, table)
    options = {k: v for k, v in known.get("storage_properties", {}).items() if k not in ("path", "serialization.format")}
    by, schema = known.get("partition_columns", []), spark.table(table).schema
    files = _Files(spark)
    # One line per touched file, numbered by folder.
    number = F.dense_rank().over(Window.orderBy("folder"))
    touched = stable(touched_files(spark, table, gone).withColumn("number", number))
    rows = touched.orderBy("path").collect()
    if not rows:
        return Deleted(0, 0, 0, 0)
    root = files.path(known["location"])
    staged = files.below(root, f"{STAGED}{uuid.uuid4().hex}")

    # Only touched files are read; what partition they are of is known from the search.
    stored = T.StructType([f for f in schema.fields if f.name not in by])
    paths = [files.path(r.path).toString() for r in rows]
    read = spark.read.format(known["provider"]).options(**options).schema(stored).load(paths)
    found = touched.select(F.col("path").alias(_PATH), F.col("number").alias(_FOLDER), *[F.col(f"`{c}`") for c in by])
    placed = read.withColumn(_PATH, F.col("_metadata.file_path")).join(found, _PATH)
    kept = placed.where(~F.coalesce(gone, F.lit(False))).select(*[F.col(f"`{c}`") for c in stored.fieldNames()], _FOLDER)
    kept.write.format(known["provider"]).options(**options).partitionBy(_FOLDER).save(staged.toString())

    folders = {r.number: r.folder for r in rows}
    moves = []
    for folder in files.listed(staged):
        name = folder.getPath().getName()
        if folder.isDirectory() and name.startswith(f"{_FOLDER}="):
            target = folders[int(name.removeprefix(f"{_FOLDER}="))]
            moves += [(f.getPath().toUri().toString(), target, f.getPath().getName()) for f in files.listed(folder.getPath())
                      if not f.getPath().getName().startswith(("_", "."))]
    journal = {"moves": moves, "gone": [r.path for r in rows],
               "partitions": sorted({(r.spec, r.folder) for r in rows if by})}
    files.write(files.below(staged, JOURNAL), json.dumps(journal))
    dropped = _carry_out(spark, table, files, staged, journal)
    return Deleted(sum(r.rows for r in rows), len(rows), len(moves), dropped)


def _carry_out(spark: SparkSession, table: str, files: _Files, staged, journal: dict) -> int:
    """What a journal says; each step may have happened already."""
    for source, folder, name in journal["moves"]:
        files.move(files.path(source), files.below(files.path(folder), name))
    for path in journal["gone"]:
        files.remove(files.path(path))
    empty = [
        spec for spec, folder in journal["partitions"]
        if not any(not f.getPath().getName().startswith(("_", ".")) for f in files.listed(files.path(folder)))
    ]
    for spec in empty:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
    files.remove(staged, True)
    spark.catalog.refreshTable(table)
    return len(empty)


def finish_deletes(spark: SparkSession, table: str) -> int:
    """Carry out deletes that were cut off behind their journal; clear away those cut off before. Gives how many."""
    files, done = _Files(spark), 0
    for folder in files.listed(files.path(_described(spark, table)["location"])):
        if folder.isDirectory() and folder.getPath().getName().startswith(STAGED):
            text = files.read(files.below(folder.getPath(), JOURNAL))
            if text is None:
                files.remove(folder.getPath(), True)
            else:
                _carry_out(spark, table, files, folder.getPath(), json.loads(text))
                done += 1
    return done
