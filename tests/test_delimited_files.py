"""Delimited files: lines split once, many small files in few tasks, no checksum file beside each."""

import glob
import os

from pyspark.sql import functions as F

from lake_queries import sources
from lake_queries.tables import Lake
from quayside.session import tune_tables
from quayside.sources import objects

SMALL = "/root/testdata/sf0.001"


def pieces(line):
    """Fields as written, character by character."""
    out, at = [""], 0
    while at < len(line):
        if line[at] == "\\":
            out[-1] += line[at : at + 2]
            at += 2
        elif line[at] == "|":
            out.append("")
            at += 1
        else:
            out[-1] += line[at]
            at += 1
    return out


def test_escaped_lines_are_split_as_written(spark):
    lines = ["a|b", "a\\|b|c", "\\\\|x", "\\\\\\|x|", "\\", "|\\", "\\x|y", "", "a\x01\\|b|c", "\x02|\\||\\\\", "||\\\\\\\\||"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in df.select(objects.split_line(F.col("line"), "|", "\\")).collect()]
    assert got == [pieces(x) for x in lines]


def test_a_filter_does_not_split_lines_again(spark, tmp_path):
    place = str(tmp_path / "t")
    spark.createDataFrame([("1998-08-01|1|2|3|4|A\\|x",)], "value string").write.text(place)
    rows = objects.scan_delimited(spark, place, sources.TRADES, delimiter="|", null_token="\\N")
    wanted = objects.on_dates(rows, "date", None, ["1998-08-01"]).where("symbol like 'A%'")
    plan = wanted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert [r["symbol"] for r in wanted.collect()] == ["A|x"]


def test_small_files_share_tasks_and_have_no_checksums(spark):
    lake = Lake(tune_tables(spark), SMALL)
    place = sources.written_text(lake, lines_per_file=10)
    files = glob.glob(f"{place}/*/part-*")
    assert len(files) > 500 and sum(1 for f in files for _ in open(f)) == lake.lineitem.count()
    assert not [f for folder, _, names in os.walk(place) for f in names if f.endswith(".crc") and f.startswith(".part")]
    read = objects.scan_delimited(spark, place, sources.TRADES, delimiter="|", null_token="\\N", nested=True)
    assert read.rdd.getNumPartitions() <= 32
