from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import ddl, directory, names, partitions, text, workflow


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def value(spark, column):
    return one(spark, column.alias("v")).v


def table(spark, object_name, usage, file_type, correlation):
    return value(spark, names.table_name(*[F.lit(x) for x in (object_name, usage, file_type, correlation)]))


def test_names_are_sanitised(spark):
    for namespace in ("meta-test", "meta test", "meta.test"):
        assert value(spark, names.database_name(F.lit(namespace))) == "meta_test"
    for name in ("table-test", "table test", "table.test"):
        assert table(spark, name, "prc-test-1", "txt", None) == "table_test_prc_test_1_txt"


def test_names_from_correlation(spark):
    original = '{"businessObject":{"original_object_name":"ABC"}}'
    assert table(spark, "X", "PRC-2", "BZ", original) == "ABC_PRC_2_BZ"
    late = '{"businessObject":{"late_reporting_for":"ABC"}}'
    for correlation, expected in [(late, "ABC"), ("{bad", "X"), ("null", "X"), ("", "X"), (None, "X")]:
        made = names.actual_object_name(F.lit("X"), F.lit(correlation))
        assert value(spark, made) == expected


def test_statistics_flag(spark):
    for asked, expected in [("NONE", False), ("none", False), ("N", True)]:
        document = '{"processing":{"collectStatistics":"%s"}}' % asked
        assert value(spark, names.collects_statistics(F.lit(document))) is expected
    assert value(spark, names.collects_statistics(F.lit(None).cast("string"))) is True


def test_storage_names(spark):
    document = '{"businessObject":{"storageNames":["A","B"]}}'
    assert value(spark, names.storage_names(F.lit(document))) == "A,B"
    assert value(spark, names.storage_names(F.lit("null"))) == "?"


def test_partition_values_expand(spark):
    cases = {
        "2020-03-01__2020-02-27": ["2020-02-27", "2020-02-28", "2020-02-29", "2020-03-01"],
        "2020-02-27__2020-03-01": ["2020-02-27"],
        "2020-02-27__2020-02-27": ["2020-02-27"],
        "a,b,c": ["a", "b", "c"],
        "2016-02-30": ["2016-02-30"],
        "none": ["none"],
    }
    for encoded, expected in cases.items():
        assert value(spark, partitions.expanded_values(F.lit(encoded))) == expected


def test_canonical_partition_names(spark):
    cases = {
        "(`TDate`='2017-08-01')": "tdate=2017-08-01",
        "(A='1', B='x/y')": "a=1/b=x/y",
        "(A='')": "A=",
        "A=1,": "a=1",
        "none": "none",
    }
    for spec, expected in cases.items():
        assert value(spark, partitions.canonical_partition(F.lit(spec))) == expected


def test_stats_partition_spec(spark):
    cases = [
        ("k", "", "`k`"),
        ("k", None, "`k`"),
        ("Partition", "none", "none"),
        ("a,b", "1,2", "`a`='1',`b`='2'"),
        ("k", "1,2", "`k`='1,2'"),
        ("k", "v", "`k`='v'"),
    ]
    for key, given, expected in cases:
        made = partitions.stats_partition_spec(F.lit(key), F.lit(given).cast("string"))
        assert value(spark, made) == expected


def same_type(spark, a, b):
    return value(spark, ddl.same_type(F.lit(a), F.lit(b)))


def test_decimal_types(spark):
    assert same_type(spark, "decimal(18,0)", "DECIMAL(18)")
    assert not same_type(spark, "decimal(18,0)", "DECIMAL(19,0)")
    assert same_type(spark, "DECIMAL", "DECIMAL(10,0)") and same_type(spark, "DECIMAL(10,0)", "DECIMAL")
    assert same_type(spark, "bigint", "BIGINT") and not same_type(spark, "int", "bigint")
    assert same_type(spark, "decimal( 18 , 8 )", "DECIMAL(18,8)")


def test_delimiters(spark):
    def same(a, b):
        return value(spark, ddl.same_character(F.lit(a), F.lit(b)))

    assert same("\\u0002", "\\002")
    assert not same("\\", "\\001") and not same("\\", "|")
    assert same("|", "|") and not same(",", "|")


REGISTERED = """CREATE EXTERNAL TABLE IF NOT EXISTS `t` (
    `ORDER_ID` BIGINT,
    `PRICE` DECIMAL(18,8) COMMENT 'the price, in euros',
    `CODE` VARCHAR(4))
PARTITIONED BY (`TRADE_DT` DATE, `KIND` STRING)
ROW FORMAT DELIMITED FIELDS TERMINATED BY '\\001' ESCAPED BY '\\\\' NULL DEFINED AS ''
STORED AS ORC;"""

LIVE = """CREATE EXTERNAL TABLE `db.t`(
`id` bigint,
`amount` decimal(10,0),
`flag` char(1))
PARTITIONED BY (
`begindate` date)
ROW FORMAT SERDE
'some.serde'
WITH SERDEPROPERTIES (
'escape.delim'='\\\\',
'field.delim'='\\u0001',
'serialization.null.format'='\\\\N')
STORED AS INPUTFORMAT"""


def test_registered_definition(spark):
    d = F.lit(REGISTERED)
    columns = value(spark, ddl.table_columns(d))
    assert [(c.ordinal, c.name, c.type) for c in columns] == [
        (0, "ORDER_ID", "BIGINT"), (1, "PRICE", "DECIMAL(18,8)"), (2, "CODE", "VARCHAR(4)"),
    ]
    parts = value(spark, ddl.partition_columns(d))
    assert [(c.name, c.type) for c in parts] == [("TRADE_DT", "DATE"), ("KIND", "STRING")]
    marks = one(spark, ddl.field_delimiter(d), ddl.escape_character(d), ddl.null_token(d))
    assert tuple(marks) == ("\\001", "\\\\", "")
    assert value(spark, ddl.parses(d))


def test_live_definition(spark):
    d = F.lit(LIVE)
    assert [c.type for c in value(spark, ddl.table_columns(d))] == ["bigint", "decimal(10,0)", "char(1)"]
    assert [c.name for c in value(spark, ddl.partition_columns(d))] == ["begindate"]
    marks = one(spark, ddl.field_delimiter(d), ddl.escape_character(d), ddl.null_token(d))
    assert tuple(marks) == ("\\u0001", "\\\\", "\\\\N")


def test_definition_that_does_not_parse(spark):
    d = F.lit("CREATE TABLE t (a int)")
    assert value(spark, ddl.parses(d)) is False
    assert value(spark, ddl.table_columns(d)) is None


def test_directory_names(spark):
    assert value(spark, directory.member_user(F.lit("cn=ann lee ,ou=People"))) == "ann lee"
    assert value(spark, directory.header_roles(F.lit("cn=a,ou=x,cn=b"))) == ["a", "b"]


def test_workflows(spark):
    labels = [value(spark, workflow.processor(F.lit(c))) for c in (0, 1, 5, 7, 8, 3)]
    assert labels == ["add partition", "add partition", "gather stats", "drop table", "back load", None]
    assert value(spark, workflow.action_label(F.lit(8))) == "Add Partition"
    codes = [
        value(spark, workflow.code_for_job(F.lit(job), F.lit(v).cast("string")))
        for job, v in [
            (workflow.SINGLETON_JOB, "x"), (workflow.MANAGED_JOB, "x"), (workflow.MANAGED_JOB, None),
            (workflow.MAIL_ONLY_JOB, "x"),
        ]
    ]
    assert codes == [1, 0, 8, None]


def test_age_is_in_whole_hours(spark):
    def old(created, hours):
        at = F.lit("2020-01-01 12:00:00").cast("timestamp")
        return value(spark, workflow.older_than(F.lit(created).cast("timestamp"), at, hours))

    assert not old("2020-01-01 09:00:00", 3)
    assert not old("2020-01-01 08:00:01", 3)
    assert old("2020-01-01 08:00:00", 3)


def test_short_lists_and_rows(spark):
    assert value(spark, partitions.short_list(F.lit("1,2,3,4,5,6"))) == "1,2,3,4,5..."
    assert value(spark, partitions.short_list(F.lit("1,2"))) == "1,2..."
    assert value(spark, partitions.short_list(F.lit("1"))) == "1"
    row = text.delimited_row([F.lit(1), F.lit(None).cast("string"), F.lit("x")], "|")
    assert value(spark, row) == "1|null|x"


def test_storage_path(spark):
    subs = F.create_map(F.lit("region"), F.lit("r1"))
    parts = [F.lit(x) for x in ("NS", "PROV", "PRC", "TXT", "OBJ", 1, 2, "TRADE_DT", "2020-01-01")]
    assert value(spark, names.storage_path(*parts, subs)) == (
        "NS/PROV/PRC/TXT/OBJ/schm-v1/data-v2/TRADE_DT=2020-01-01/region=r1"
    )
    assert value(spark, names.storage_path(*parts, subs, hyphenated=True)) == (
        "ns/prov/prc/txt/obj/schm-v1/data-v2/trade-dt=2020-01-01/region=r1"
    )
