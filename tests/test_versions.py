"""Objects stored under several registered formats."""

from __future__ import annotations

import datetime
import decimal
import re

import pytest

from quayside.sources import versions

KEY = "namespace string, object_name string, usage_code string, file_type string"
FORMATS = {
    1: [("id", "int"), ("trade_dt", "date"), ("price", "string"), ("old name", "string")],
    2: [("id", "bigint"), ("trade_dt", "date"), ("price", "decimal"), ("new_name", "string")],
    5: [("id", "bigint"), ("trade_dt", "date"), ("price", "double"), ("new_name", "string"), ("added", "int")],
}
ROWS = {  # by version: partition value, rows
    1: [("2020-01-01", [(1, "2020-01-01", "1.5", "a"), (2, None, "n/a", None)])],
    2: [("2020-01-02", [(3, "2020-01-02", "7", "b")]), ("2020-01-01", [(9, None, "1", "archived")])],
    5: [("2020-01-03", [(4, "2020-01-03", "2.25", "c", 40)])],
}


@pytest.fixture
def stored(spark, tmp_path):
    def make(kind):
        key, data = ("NS", "O", "U", kind), []
        for version, parts in ROWS.items():
            for value, rows in parts:
                place = tmp_path / kind / f"schm-v{version}" / "data-v0" / f"trade-dt={value}"
                names = [f"c{k}" for k in range(len(FORMATS[version]))]
                df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
                if kind == "ORC":
                    types = {"decimal": "decimal(18,4)"}
                    df.selectExpr(*[f"cast({c} as {types.get(t, t)}) as `{n}`" for c, (n, t) in zip(names, FORMATS[version])]).write.orc(str(place))
                else:
                    mark = ";" if version == 2 else "|"
                    df.selectExpr(f"concat_ws('{mark}', {', '.join(f'coalesce({c}, chr(126))' for c in names)}) as line").coalesce(1).write.text(str(place))
                status = "ARCHIVED" if (version, value) == (2, "2020-01-01") else "VALID"
                data.append((*key, value, None, version, 0, status, "S", str(place), 1))
        listed = [(*key, v, False, at, n, t, "18,4" if t == "decimal" else None) for v, cs in FORMATS.items() for at, (n, t) in enumerate(cs)]
        listed += [(*key, v, True, 0, "TRADE_DT", "date", None) for v in FORMATS]
        columns = spark.createDataFrame(listed, f"{KEY}, format_version int, is_partition boolean, ordinal int, name string, type string, size string")
        marks = spark.createDataFrame(
            [(*key, v, ";" if v == 2 else "|", "", "~") for v in FORMATS], f"{KEY}, format_version int, delimiter string, escape string, null_token string")
        registered = spark.createDataFrame(
            data, f"{KEY}, partition_value string, sub_partition_values array<string>, format_version int, data_version long, status string, "
            "storage_name string, file_path string, file_size long")
        return key, columns, marks, registered

    return make


DAY = datetime.date


@pytest.mark.parametrize("kind", ["ORC", "TXT"])
def test_renamed_retyped_and_added_columns(spark, stored, kind):
    key, columns, marks, data = stored(kind)
    read = versions.scan_versions(spark, columns, marks, key, data)
    assert read.dtypes == [("id", "bigint"), ("trade_dt", "date"), ("price", "double"), ("new_name", "string"), ("added", "int"),
                           ("partition_trade_dt", "date")]
    assert sorted(tuple(r) for r in read.collect()) == [
        (1, DAY(2020, 1, 1), 1.5, "a", None, DAY(2020, 1, 1)), (2, None, None, None, None, DAY(2020, 1, 1)),
        (3, DAY(2020, 1, 2), 7.0, "b", None, DAY(2020, 1, 2)), (4, DAY(2020, 1, 3), 2.25, "c", 40, DAY(2020, 1, 3)),
    ]
    # One scan per stored version; the archived partition is not read.
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan (orc|text)", plan)) == 3
    assert not any("schm-v2/data-v0/trade-dt=2020-01-01" in f for f in read.inputFiles())
    # An older format as the wanted one: its names and types, and no column it lacks.
    older = versions.scan_versions(spark, columns, marks, key, data, version=2)
    assert older.columns == ["id", "trade_dt", "price", "new_name", "partition_trade_dt"]
    assert sorted((r.id, r.price) for r in older.collect() if r.price is not None) == [
        (1, decimal.Decimal("1.5")), (3, decimal.Decimal(7)), (4, decimal.Decimal("2.25"))]


def test_versions_without_registration_are_told(spark, stored):
    key, columns, marks, data = stored("ORC")
    fewer = columns.where("format_version <> 2")
    with pytest.raises(ValueError, match=r"without registration: \{2: 1\}"):
        versions.scan_versions(spark, fewer, marks, key, data)
    assert [r.partition_value for r in versions.unregistered_partitions(data, fewer).collect()] == ["2020-01-02"]
    assert versions.unregistered_partitions(data, columns).count() == 0
    with pytest.raises(ValueError, match="no registered format version"):
        versions.scan_versions(spark, columns, marks, key, data, version=3)
    nothing = versions.scan_versions(spark, columns, marks, key, data.limit(0))
    assert nothing.count() == 0 and nothing.columns[-1] == "partition_trade_dt"


def test_values_without_a_conversion_are_null(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(5, "2020-01-01", "x", True)], "n long, d string, s string, b boolean")
    shown = df.select(
        versions.converted(df.n, T.LongType(), T.DateType()).alias("a"), versions.converted(df.d, T.StringType(), T.DateType()).alias("b"),
        versions.converted(df.s, T.StringType(), T.IntegerType()).alias("c"), versions.converted(df.b, T.BooleanType(), T.StringType()).alias("d"),
        versions.converted(df.n + 2**40, T.LongType(), T.IntegerType()).alias("e"),
    )
    assert tuple(shown.first()) == (None, DAY(2020, 1, 1), None, "true", None)
