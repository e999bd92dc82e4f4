from __future__ import annotations

import bz2
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.text import rendered
from quayside.operators import registration
from quayside import schemas
from quayside.sources import documents, objects, sinks
from quayside.sources import registered as by_registration
from quayside.streaming import arrivals, heartbeats, permissions

SECURITY = (
    T.StructType().add("date", "date").add("open", "float").add("high", "float").add("low", "float")
    .add("close", "float").add("volume", "long").add("symbol", "string")
)
DAY = T.StructType().add("tdate", "string")
LINES = {
    "2017-08-01": {
        "a.txt": "2017-08-01,11.5,12.25,11.0,12.0,1500,QQA\n2017-08-01,40.75,41.0,39.5,40.5,72000,QQB",
        "b.txt": "2017-08-01,8.25,8.5,8.0,8.125,31000,QQC",
    },
    "2017-08-02": {
        "a.txt": "2017-08-02,12.0,13.5,11.75,13.0,1700,QQA\n2017-08-02,40.5,42.0,40.25,41.75,69000,QQB\n",
    },
}


@pytest.fixture
def security(tmp_path):
    root = tmp_path / "security"
    for day, files in LINES.items():
        folder = root / f"tdate={day}"
        folder.mkdir(parents=True)
        for name, body in files.items():
            (folder / name).write_text(body)
    return str(root)


def scan(spark, root):
    return objects.scan_delimited(spark, root, SECURITY, partitions=DAY, base_path=root)


def lines(df, delimiter=","):
    return [r.line for r in rendered(df, delimiter).collect()]


def test_date_and_symbol_query(spark, security):
    found = scan(spark, security).where(
        "date = date'2017-08-01' and (symbol = 'QQA' or symbol = 'QQC')"
    )
    assert sorted(lines(found)) == [
        "2017-08-01,11.5,12.25,11.0,12.0,1500,QQA,2017-08-01",
        "2017-08-01,8.25,8.5,8.0,8.125,31000,QQC,2017-08-01",
    ]


def test_dates_in_order_query(spark, security):
    found = scan(spark, security).where(
        "date in (date'2017-08-01', date'2017-08-02') and symbol = 'QQB'"
    ).orderBy("date")
    assert lines(found, "|") == [
        "2017-08-01|40.75|41.0|39.5|40.5|72000|QQB|2017-08-01",
        "2017-08-02|40.5|42.0|40.25|41.75|69000|QQB|2017-08-02",
    ]


def test_declared_dates_skip_folders(spark, security):
    found = objects.on_dates(scan(spark, security), "date", "tdate", ["2017-08-02"])
    assert found.count() == 2
    assert len(found.inputFiles()) == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tdate" in plan or "tdate#" in plan.split("PartitionFilters")[1][:60]


def test_escapes_nulls_and_bad_values(spark, tmp_path):
    (tmp_path / "x.dat").write_text("1|a\\|b|\\N\n2|c\\\\|\\\\N\n3|\\N|\nbad|x\n")
    schema = T.StructType().add("id", "integer").add("name", "string").add("note", "string")
    read = objects.scan_delimited(spark, str(tmp_path), schema, "|", "\\", "\\N")
    assert [tuple(r) for r in read.collect()] == [
        (1, "a|b", None), (2, "c\\", "\\N"), (3, None, ""), (None, "x", None),
    ]


def test_control_character_delimiter_and_bzip2(spark, tmp_path):
    folder = tmp_path / "schm-v0" / "data-v1" / "trade-dt=2020-01-02" / "kind=x"
    folder.mkdir(parents=True)
    (folder / "part.dat.bz2").write_bytes(bz2.compress(b"1\x01a\n2\x01b\n"))
    schema = T.StructType().add("id", "integer").add("name", "string")
    read = objects.scan_delimited(
        spark, str(tmp_path), schema, "\\u0001", nested=True, path_keys=["TRADE_DT", "kind"]
    )
    assert sorted(tuple(r) for r in read.collect()) == [(1, "a", "2020-01-02", "x"), (2, "b", "2020-01-02", "x")]


def test_manifest_counts_as_number_or_text(spark, tmp_path):
    for at, count in enumerate([504, "2"]):
        document = {
            "namespace": "NS", "businessObjectDefinitionName": "O", "partitionKey": "TDATE",
            "businessObjectFormatUsage": "U", "businessObjectFormatFileType": "TXT",
            "businessObjectFormatVersion": "0", "partitionValue": "2017-08-02",
            "manifestFiles": [{"fileName": f"{at}.txt", "rowCount": count}],
        }
        (tmp_path / f"{at}.json").write_text(json.dumps(document, indent=2))
    found = documents.scan_manifests(spark, str(tmp_path))
    assert {r.file_name: r.row_count for r in found.collect()} == {"0.txt": 504, "1.txt": 2}


def test_format_registration(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        """<?xml version="1.0" encoding="UTF-8"?>
<businessObjectFormatCreateRequest>
  <namespace>NS</namespace><businessObjectDefinitionName>O</businessObjectDefinitionName>
  <businessObjectFormatUsage>U</businessObjectFormatUsage><businessObjectFormatFileType>ORC</businessObjectFormatFileType>
  <partitionKey>DT</partitionKey>
  <schema><columns>
    <column><name>A</name><type>BIGINT</type><required>true</required><description>first</description></column>
    <column><name>B</name><type>VARCHAR</type><size>4</size><required>false</required></column>
  </columns><partitions><column><name>DT</name><type>DATE</type></column></partitions>
  <nullValue></nullValue><delimiter>\\001</delimiter><escapeCharacter>\\\\</escapeCharacter></schema>
</businessObjectFormatCreateRequest>"""
    )
    found = documents.scan_format_columns(spark, str(tmp_path)).orderBy("is_partition", "ordinal").collect()
    assert [(r.is_partition, r.ordinal, r.name, r.type, r.size) for r in found] == [
        (False, 0, "A", "BIGINT", None), (False, 1, "B", "VARCHAR", "4"), (True, 0, "DT", "DATE", None),
    ]
    marks = documents.scan_format_marks(spark, str(tmp_path)).first()
    assert (marks.partition_key, marks.delimiter, marks.escape, marks.null_token) == ("DT", "\\001", "\\\\", "")


REQUESTS = """# comment

namespace|businessObjectDefinitionName|usage|fileType|Workflow Type|Action|
NS|OBJ_1|PRC|TXT|DM Managed|add|
NS | OBJ_2 |PRC|TXT|Singleton|enable|
NS|OBJ_2|PRC|TXT|Batch|add|
NS|OBJ_2||TXT|Singleton|add|
NS|OBJ_2|PRC|TXT|Singleton|remove|
NS|OB*J|PRC|TXT|Singleton|add|
NS|OBJ_1|PRC|TXT|DM Managed|disable|
NS|OBJ_3|PRC|TXT|DM Managed|drop|
NS|OBJ_4|PRC|TXT|DM Managed|add|missing.json|
"""


def test_registration_requests(spark, tmp_path):
    (tmp_path / "requests.txt").write_text(REQUESTS)
    files = spark.createDataFrame([("bad.json", "{")], "json_file string, content string")
    judged = registration.validated(documents.scan_requests(spark, str(tmp_path)), files)
    reasons = [r.reason for r in judged.orderBy("place").collect()]
    assert reasons == [
        None, None, "Invalid workflow type provided.", "Missing expected parameter from line.",
        "Invalid action provided.", "Line contains bad characters.", None, None, "Expected json file not present.",
    ]
    accepted, rejected = registration.split_requests(judged)
    assert (accepted.count(), rejected.count()) == (4, 5)
    before = spark.createDataFrame(
        [("NS_OBJ_3_PRC_TXT", "NS", "OBJ_3", "PRC", "TXT", "data", "", "x", "ENABLED"), ("other", "NS", "X", "PRC", "TXT", "data", "", "x", "ENABLED")],
        ", ".join(f"{c} string" for c in registration.REGISTRATION),
    )
    merged = registration.merged_registrations(before, accepted)
    assert {r.notification_name: (r.status, r.job_name[:5]) for r in merged.collect()} == {
        "other": ("ENABLED", "x"),
        "NS_OBJ_1_PRC_TXT": ("DISABLED", "addPa"),
        "NS_OBJ_1_PRC_TXT_EMAIL": ("ENABLED", "email"),
        "NS_OBJ_1_PRC_TXT_ARCHIVE": ("ENABLED", "addPa"),
        "NS_OBJ_1_PRC_TXT_RESTORE": ("ENABLED", "addPa"),
        "NS_OBJ_1_PRC_TXT_EXPIRE": ("ENABLED", "addPa"),
        "NS_OBJ_2_PRC_TXT": ("ENABLED", "singl"),
    }
    assert [r.object_name for r in registration.drop_items(accepted).collect()] == ["OBJ_3"]


EVENT = (
    "event_id int, event_type string, namespace string, object_name string, usage_code string, file_type string, "
    "partition_key string, partition_value string, new_status string, storage_name string"
)
REGISTRATION = (
    "notification_name string, namespace string, event_type string, object_name string, usage_code string, "
    "file_type string, new_status string, storage_name string, status string, job_name string, correlation_data string"
)
DATA = arrivals.DATA_EVENT


def registered(spark):
    job = "addPartitionWorkflow"
    return spark.createDataFrame(
        [
            ("exact", "NS", DATA, "O", "U", "TXT", "VALID", "S3", "ENABLED", job, "c"),
            ("open", "NS", DATA, None, None, None, None, None, "ENABLED", "singletonObjectsAddPartitionWorkflow", None),
            ("off", "NS", DATA, None, None, None, None, None, "DISABLED", job, None),
            ("mail", "NS", DATA, None, None, None, None, None, "ENABLED", "emailDisabledObjectsWorkflow", None),
        ],
        REGISTRATION,
    )


def events(spark):
    return spark.createDataFrame(
        [
            (1, DATA, "NS", "O", "U", "TXT", "d", "2020-01-01", "VALID", "S3"),
            (2, DATA, "NS", "O", "U", "TXT", "d", "2020-01-02", "INVALID", "S3"),
            (3, DATA, "XX", "O", "U", "TXT", "d", "2020-01-03", "VALID", "S3"),
            (4, arrivals.STORAGE_EVENT, "NS", "O", "U", "TXT", "d", "2020-01-04", "VALID", "S3"),
        ],
        EVENT,
    )


def test_events_match_registrations(spark):
    made = arrivals.work_items(events(spark), registered(spark)).collect()
    assert sorted((r.event_id, r.notification_name, r.wf_type) for r in made) == [
        (1, "exact", 0), (1, "open", 1), (2, "open", 1),
    ]
    assert arrivals.work_items(events(spark), registered(spark).where("false")).count() == 0


def test_stream_of_events_equals_the_batch_and_repeats_cleanly(spark, tmp_path, rows):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    events(spark).write.parquet(source)

    def run():
        stream = spark.readStream.schema(events(spark).schema).parquet(source)
        arrivals.start_arrivals(stream, lambda: registered(spark), sink, str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(sink).drop("batch")

    expected = rows(arrivals.work_items(events(spark), registered(spark)))
    assert rows(run()) == expected
    assert rows(run()) == expected
    events(spark).withColumn("event_id", F.col("event_id") + 10).write.mode("append").parquet(source)
    assert run().count() == 2 * len(expected)


def test_permission_messages(spark, rows):
    bodies = [
        '{"action":"delta_sync","userId":"ann","namespace":"NS"}',
        '{"action":"full_sync"}',
        '{"action":"delta_sync","userId":"*"}',
        '{"action":"other","userId":"x","namespace":"NS"}',
        "no json",
    ]
    messages = spark.createDataFrame([(b,) for b in bodies], "value string")
    assert rows(permissions.parsed_messages(messages)) == [("", "*"), ("NS", "ann")]
    assert rows(permissions.rejected_messages(messages)) == sorted((b,) for b in bodies[2:])


def test_private_use_characters_and_escapes(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text("a\ue000b\ue001c,x\\,y,z\\\\,\n,\\\\N,\\,,end\\\nplain,b,c,d")
    schema = T.StructType().add("a", "string").add("b", "string").add("c", "string").add("d", "string")
    read = objects.scan_delimited(spark, str(tmp_path / "lines"), schema, null_token="\\\\N")
    assert [tuple(r) for r in read.collect()] == [
        ("a\ue000b\ue001c", "x,y", "z\\", ""), ("", None, ",", "end"), ("plain", "b", "c", "d"),
    ]


def test_values_in_paths_are_unescaped(spark, tmp_path):
    given = ["a b", "O'Brien", "10:30", "50%", "x=y", "1+1", "é"]
    spark.createDataFrame([(v, v) for v in given], "v string, part_key string").write.partitionBy("part_key").text(str(tmp_path / "o"))
    (tmp_path / "o" / "part-key=5%").mkdir()
    (tmp_path / "o" / "part-key=5%" / "a.txt").write_text("5%")
    read = objects.scan_delimited(spark, str(tmp_path / "o"), T.StructType().add("v", "string"), "|", nested=True, path_keys=["part_key"])
    assert sorted((r.v, r.part_key) for r in read.collect()) == sorted((v, v) for v in [*given, "5%"])


def test_lease_history_in_a_stream(spark, tmp_path):
    beats = spark.createDataFrame(
        [(t,) for t in ("12:00:00", "12:01:00", "12:04:00", "12:30:00", "13:30:00")], "t string"
    ).select(
        *[F.lit("x").alias(c) for c in ("namespace", "object_name", "usage_code", "file_type", "cluster_id", "worker_id")],
        F.concat(F.lit("2020-01-01 "), "t").cast("timestamp").alias("heartbeat"),
    )
    whole = heartbeats.lease_history(beats).orderBy("acquired").collect()
    assert [r.beats for r in whole] == [3, 1, 1]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    beats.coalesce(1).write.parquet(source)
    stream = heartbeats.lease_history(spark.readStream.schema(beats.schema).parquet(source))
    started = (
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    # The last span is open until the watermark passes it.
    assert [r.beats for r in spark.read.parquet(sink).orderBy("acquired").collect()] == [3, 1]


def test_lease_history_of_a_busy_worker(spark):
    """Many beats within minutes give the same spans as one by one."""
    beats = spark.range(4000).select(
        *[F.lit("x").alias(c) for c in ("namespace", "object_name", "usage_code", "file_type", "cluster_id", "worker_id")],
        F.timestamp_micros(F.col("id") * 1_700_000 + F.when(F.col("id") > 2500, 400_000_000).otherwise(0)).alias("heartbeat"),
    )
    found = heartbeats.lease_history(beats).orderBy("acquired").collect()
    assert [r.beats for r in found] == [2501, 1499]
    assert (found[0].expires - found[0].acquired).total_seconds() == pytest.approx(2500 * 1.7 + 300)


def test_partitions_in_the_catalog(spark, tmp_path, rows):
    sinks.create_database(spark, "market_data")
    name, root = "market_data.securitydata_u_txt", str(tmp_path)
    days = ["1970-01-01", "2020-01-01", "2020-01-02", "2020-01-03"]
    for at, day in enumerate(days):
        spark.range(at + 1).write.parquet(f"{root}/{day}")
    schema = T.StructType().add("id", "long").add("tdate", "string")
    sinks.create_table(spark, name, schema, f"{root}/table", "parquet", ["tdate"])

    def parts(*chosen):
        return spark.createDataFrame([(f"tdate='{d}'", f"{root}/{d}") for d in chosen], "spec string, location string")

    assert sinks.add_partitions(spark, name, parts(*days[:3])) == 3
    assert sinks.add_partitions(spark, name, parts(*days[:3]), at_once=2) == 3
    assert spark.table(name).count() == 1 + 2 + 3
    assert [r.tableName for r in spark.sql("SHOW TABLES IN market_data").collect()] == ["securitydata_u_txt"]
    assert sinks.listed_partitions(spark, name, f"tdate='{days[1]}'").count() == 1
    sinks.replace_partitions(spark, name, "tdate", parts(days[3]), at_once=1)
    assert rows(sinks.listed_partitions(spark, name)) == [("tdate=1970-01-01",), ("tdate=2020-01-03",)]
    assert spark.table(name).count() == 1 + 4
    sinks.analyze(spark, name, partition=f"tdate='{days[3]}'")
    described = spark.sql(f"DESCRIBE EXTENDED {name} PARTITION (tdate='{days[3]}')")
    assert "4 rows" in described.where("col_name = 'Partition Statistics'").first().data_type


def test_repointed_table(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(5).write.parquet(str(tmp_path / "b"))
    sinks.create_table(spark, "moving", T.StructType().add("id", "long"), str(tmp_path / "a"))
    assert spark.table("moving").count() == 3
    sinks.repoint_table(spark, "moving", str(tmp_path / "b"))
    assert spark.table("moving").count() == 5
    sinks.drop_object(spark, "moving")


def test_request_lines_are_numbered_over_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# x\nN|A|U|T|Singleton|add|\nN|B|U|T|Singleton|add|\n")
    (tmp_path / "b.txt").write_text("N|C|U|T|Singleton|add|\n")
    found = documents.line_numbers(documents.scan_requests(spark, str(tmp_path))).orderBy("line_no")
    assert [(r.line_no, r.object_name) for r in found.collect()] == [(1, "A"), (2, "B"), (3, "C")]


FORMAT = """<businessObjectFormatCreateRequest><namespace>NS</namespace>
<businessObjectDefinitionName>O</businessObjectDefinitionName><businessObjectFormatUsage>U</businessObjectFormatUsage>
<businessObjectFormatFileType>%s</businessObjectFormatFileType><partitionKey>TRADE_DT</partitionKey><schema><columns>
<column><name>ID</name><type>BIGINT</type></column><column><name>TRADE_DT</name><type>DATE</type></column>
<column><name>PRICE</name><type>DECIMAL</type><size>18,8</size></column>
<column><name>CODE</name><type>VARCHAR</type><size>4</size></column></columns>
<partitions><column><name>TRADE_DT</name><type>DATE</type></column></partitions>
<nullValue>\\N</nullValue><delimiter>\\001</delimiter><escapeCharacter>\\</escapeCharacter></schema></businessObjectFormatCreateRequest>"""


@pytest.mark.parametrize("file_type", ["BZ", "ORC"])
def test_scan_by_registration(spark, tmp_path, file_type):
    formats, root = tmp_path / "formats", tmp_path / "data"
    formats.mkdir()
    (formats / "f.xml").write_text(FORMAT % file_type)
    columns = documents.scan_format_columns(spark, str(formats))
    marks = documents.scan_format_marks(spark, str(formats))
    folder = root / "schm-v1" / "data-v0" / "trade-dt=2020-01-02"
    if file_type == "BZ":
        folder.mkdir(parents=True)
        (folder / "x.dat.bz2").write_bytes(bz2.compress(b"7\x012020-01-01\x011.5\x01AB\n8\x01\\N\x01\\N\x01\\N\n"))
    else:
        spark.sql(
            "select 7L id, date'2020-01-01' trade_dt, cast(1.5 as decimal(18,8)) price, 'AB' code "
            "union all select 8L, null, null, null"
        ).write.orc(str(folder))
    read = by_registration.scan_registered(spark, columns, marks, ("NS", "O", "U", file_type), str(root))
    assert read.columns == ["id", "trade_dt", "price", "code", "partition_trade_dt"]
    assert [t for _, t in read.dtypes] == ["bigint", "date", "decimal(18,8)", "string", "date"]
    assert sorted((r.id, str(r.price), r.code, str(r.partition_trade_dt)) for r in read.collect()) == [
        (7, "1.50000000", "AB", "2020-01-02"), (8, "None", None, "2020-01-02"),
    ]


def test_declared_types():
    kinds = {
        ("DECIMAL", None): "decimal(10,0)", ("decimal(5,2)", None): "decimal(5,2)", ("CHAR(3)", None): "string",
        ("Float", None): "float", ("datetime", None): "timestamp", ("String", None): "string", ("INT", None): "int",
    }
    assert {k: schemas.column_type(*k).simpleString() for k in kinds} == kinds
    assert all(schemas.schema(t).fields for t in schemas.TABLES)
