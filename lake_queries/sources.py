"""Scans and sinks: the given tables written out in a registered form and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lake_queries import access as access_queries
from lake_queries import work as work_queries
from lake_queries.evolution import NEW_ORDERS
from lake_queries.registry import query
from quayside.functions import names, text
from quayside.operators import access, profile
from quayside.schemas import column_type
from quayside.session import stable, work_dir
from quayside.sources import catalog, deletes, documents, listing, objects, registered, sinks, versions
from quayside.streaming import idle, permissions, refresh

TRADES = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("order", T.LongType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("symbol", T.StringType()),
    ]
)
DAY = T.StructField("tdate", T.StringType())
SQL = """SELECT cast(l_shipdate AS date) AS date, l_orderkey AS "order", l_quantity AS quantity, l_extendedprice AS price,
  CASE WHEN l_tax < 0.01 THEN NULL ELSE l_partkey END AS volume,
  concat(l_returnflag, '|', l_linestatus, '\\', cast(l_suppkey AS varchar)) AS symbol, strftime(l_shipdate, '%Y-%m') AS tdate FROM lineitem"""
SHOWN = """cast(date AS varchar) AS date, "order", quantity, price, coalesce(volume, -1) AS volume, symbol, tdate"""


# Local files without a second one of checksums beside each; other file systems don't know these options.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def trades(lake):
    """Line items in the shape of a traded-securities object, by month."""
    return lake.lineitem.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_orderkey").alias("order"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_tax") >= 0.01, F.col("l_partkey")).alias("volume"),
        F.concat("l_returnflag", F.lit("|"), "l_linestatus", F.lit("\\"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.date_format("l_shipdate", "yyyy-MM").alias("tdate"),
    )


def written_text(lake, compression="none", lines_per_file=0):
    """Where the trades lie as delimited text, a folder per month."""
    place = work_dir(lake.spark, "trades")
    # Delimiters and escapes in a value are written with the escape in front.
    escaped = F.replace(F.replace("symbol", F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    fields = [F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("\\N")) for f in TRADES.fields[:-1]]
    lines = trades(lake).select(F.concat_ws("|", *fields, escaped).alias("line"), "tdate")
    # A month goes to as many tasks as its lines ask for, and each puts its files in place by itself.
    lines.hint("rebalance", F.col("tdate")).write.partitionBy("tdate").option("maxRecordsPerFile", lines_per_file).option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2"
    ).options(**PLAIN_FILES).text(place, compression=compression)
    return place


def scanned(lake, place, **options):
    return objects.scan_delimited(
        lake.spark, place, TRADES, delimiter="|", null_token="\\N",
        partitions=T.StructType([DAY]), base_path=place, **options,
    )


def shown(df):
    return df.withColumn("date", F.col("date").cast("string")).withColumn(
        "volume", F.coalesce("volume", F.lit(-1).cast("long"))
    )


@query("src1_delimited_scan", f"SELECT {SHOWN} FROM ({SQL})")
def delimited_scan(lake):
    return shown(scanned(lake, written_text(lake)))


@query("src2_several_files", f"SELECT {SHOWN} FROM ({SQL})")
def several_files(lake):
    """Every file anywhere below the root, with the partition taken from its path."""
    place = written_text(lake, lines_per_file=200)
    return shown(objects.scan_delimited(
        lake.spark, place, TRADES, delimiter="|", null_token="\\N", nested=True, path_keys=["tdate"]
    ))


@query(
    "src3_latest_version",
    """SELECT c_custkey, c_mktsegment AS segment FROM customer
    WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR c_custkey % 2 = 0""",
)
def latest_version(lake):
    """Two stored versions of some partitions; the registered data says which one counts."""
    root, key = work_dir(lake.spark, "versioned"), ("NS", "CUSTOMERS", "PRC", "TXT")
    newer = "c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey % 2 = 0"
    for version, rows in enumerate((lake.customer, lake.customer.where(newer))):
        rows.select(F.col("c_custkey").cast("string").alias("line"), F.col("c_mktsegment").alias("segment")).write.partitionBy(
            "segment").text(f"{root}/schm-v0/data-v{version}")
    stored = [lake.customer.select("c_mktsegment", F.lit(0).alias("v")), lake.customer.where(newer).select("c_mktsegment", F.lit(1).alias("v"))]
    data = stored[0].unionByName(stored[1]).distinct().select(
        *[F.lit(v).alias(n) for n, v in zip(names.OBJECT_KEY, key)], F.col("c_mktsegment").alias("partition_value"),
        F.lit(None).cast("array<string>").alias("sub_partition_values"), F.lit(0).alias("format_version"),
        F.col("v").cast("long").alias("data_version"), F.lit("VALID").alias("status"),
        F.format_string(f"{root}/schm-v0/data-v%d/segment=%s", "v", "c_mktsegment").alias("file_path"),
    )
    columns = lake.spark.createDataFrame(
        [(*key, "c_custkey", "bigint", None, 0, False), (*key, "SEGMENT", "string", None, 0, True)],
        "namespace string, object_name string, usage_code string, file_type string, name string, type string, size string, ordinal int, is_partition boolean",
    )
    marks = lake.spark.createDataFrame(
        [(*key, "|", "", "")],
        "namespace string, object_name string, usage_code string, file_type string, delimiter string, escape string, null_token string",
    )
    return registered.scan_current(lake.spark, columns, marks, key, data)


# Fixed values of the example: the columns of an object's three registered formats, and the delimiter of each.
ORDER_FORMATS = {
    0: ("|", [("order_id", "INT"), ("customer", "bigint"), ("price", "varchar(30)"), ("state", "char(1)")]),
    1: (";", [("order_id", "bigint"), ("client", "bigint"), ("price", "double"), ("state", "char(1)")]),
    2: ("|", [("order_id", "bigint"), ("client", "bigint"), ("price", "double"), ("status", "char(1)"), ("priority", "string")]),
}


@query(
    "sch5_stored_versions",
    """SELECT kind, o_orderkey AS order_id, o_custkey AS client, o_totalprice AS price, o_orderstatus AS status,
      CASE WHEN year(o_orderdate) % 3 = 2 THEN o_orderpriority ELSE '' END AS priority, year(o_orderdate)::VARCHAR AS tyear
    FROM orders, (VALUES ('ORC'), ('TXT')) kinds(kind)""",
)
def stored_versions(lake):
    """Orders by year, stored under three formats: renamed, retyped and added columns, old versions left behind."""
    root, year = work_dir(lake.spark, "formats"), F.year("o_orderdate")
    rows = lake.orders.withColumn("year", year).withColumn("v", year % 3)
    # Under the first format lie old rows of every year, which newer versions replace.
    old = rows.where("v > 0").withColumn("o_orderkey", -F.col("o_orderkey")).withColumn("v", F.lit(0))
    stored = stable(rows.withColumn("data", F.lit(1)).unionByName(old.withColumn("data", F.lit(0))))
    source = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    for version, (mark, columns) in ORDER_FORMATS.items():
        part = stored.where(F.col("v") == version)
        typed = [F.col(c).cast(column_type(kind)).alias(n) for c, (n, kind) in zip(source, columns)]
        placed = part.select(*typed, F.concat(F.lit("data-v"), "data").alias("data"), F.col("year").alias("tyear"))
        placed.write.partitionBy("data", "tyear").orc(f"{root}/ORC/schm-v{version}")
        placed.select(F.concat_ws(mark, *[n for n, _ in columns]).alias("line"), "data", "tyear").write.partitionBy("data", "tyear").text(
            f"{root}/TXT/schm-v{version}")
    read = None
    for kind in ("ORC", "TXT"):
        key = ("NS", "ORDERS", "PRC", kind)
        named = dict(zip(names.OBJECT_KEY, key))
        own = [F.lit(v).alias(n) for n, v in named.items()]
        data = stored.select("v", "data", "year").distinct().select(
            *own, F.col("year").cast("string").alias("partition_value"), F.lit(None).cast("array<string>").alias("sub_partition_values"),
            F.col("v").alias("format_version"), F.col("data").cast("long").alias("data_version"), F.lit("VALID").alias("status"),
            F.format_string(f"{root}/{kind}/schm-v%d/data=data-v%d/tyear=%d", "v", "data", "year").alias("file_path"),
        )
        listed = [(*key, v, False, at, n, t, None) for v, (_, columns) in ORDER_FORMATS.items() for at, (n, t) in enumerate(columns)]
        listed += [(*key, v, True, 0, "TYEAR", "string", None) for v in ORDER_FORMATS]
        ids = ", ".join(f"{n} string" for n in names.OBJECT_KEY) + ", format_version int"
        columns = lake.spark.createDataFrame(listed, f"{ids}, is_partition boolean, ordinal int, name string, type string, size string")
        marks = lake.spark.createDataFrame(
            [(*key, v, mark, "", "") for v, (mark, _) in ORDER_FORMATS.items()], f"{ids}, delimiter string, escape string, null_token string"
        )
        found = versions.scan_versions(lake.spark, columns, marks, key, data).withColumn("kind", F.lit(kind))
        read = found if read is None else read.unionByName(found)
    return read.withColumn("priority", F.coalesce("priority", F.lit("")))


@query("src3_path_values", """SELECT c_custkey, c_nationkey::varchar AS trade_nation, c_mktsegment AS segment FROM customer""")
def path_values(lake):
    """Versioned folders whose names spell the keys with hyphens."""
    place = work_dir(lake.spark, "versions") + "/schm-v0/data-v0"
    lake.customer.select(
        "c_custkey", F.col("c_nationkey").alias("trade-nation"), F.col("c_mktsegment").alias("SEGMENT")
    ).repartition(8, "SEGMENT", "trade-nation").write.partitionBy("trade-nation", "SEGMENT").csv(place)
    return objects.scan_delimited(
        lake.spark, place, T.StructType().add("c_custkey", "long"), nested=True,
        path_keys=["TRADE_NATION", "segment"],
    )


@query(
    "src4_columnar_scan",
    """SELECT o_orderkey AS order_id, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS price,
      cast(cast(o_orderdate AS date) AS varchar) AS day, o_orderpriority AS urgency, '' AS note FROM orders""",
)
def columnar_scan(lake):
    """ORC files written under the old schema, read under a wider one by position."""
    place = work_dir(lake.spark, "orc")
    stored = lake.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority",
    )
    stored.write.orc(place)
    read = objects.scan_columnar(lake.spark, place, stored.schema, NEW_ORDERS)
    return read.withColumn("day", F.col("day").cast("string")).withColumn("note", F.coalesce("note", F.lit("")))


@query("src5_compressed_text", f"SELECT {SHOWN} FROM ({SQL})")
def compressed_text(lake):
    return shown(scanned(lake, written_text(lake, compression="bzip2")))


@query(
    "src6_manifests",
    """SELECT concat('S', cast(l_suppkey AS varchar)) AS object_name, strftime(l_shipdate, '%Y-%m') AS partition_value,
      concat('part-', l_returnflag, '.txt') AS file_name, count(*) AS row_count FROM lineitem GROUP BY ALL""",
)
def manifests(lake):
    return documents.scan_manifests(lake.spark, written_manifests(lake), False).select(
        "object_name", "partition_value", "file_name", "row_count"
    )


def written_manifests(lake):
    counted = lake.lineitem.groupBy(
        "l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag"
    ).agg(F.count(F.lit(1)).alias("n"))
    file = F.struct(
        F.concat(F.lit("part-"), "l_returnflag", F.lit(".txt")).alias("fileName"),
        F.col("n").cast("string").alias("rowCount"),
    )
    place = work_dir(lake.spark, "manifests")
    # At most one file entry per return flag.
    counted.groupBy(
        F.lit("NS").alias("namespace"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("businessObjectDefinitionName"),
        F.lit("PRC").alias("businessObjectFormatUsage"),
        F.lit("TXT").alias("businessObjectFormatFileType"),
        F.lit("0").alias("businessObjectFormatVersion"),
        F.lit("TDATE").alias("partitionKey"),
        F.col("month").alias("partitionValue"),
    ).agg(F.collect_list(file).alias("manifestFiles")).write.json(place)
    return place


def written_formats(lake):
    """A registration document per table, from its columns."""
    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    column = F.concat(
        F.lit("<column>"), tag("name", F.col("name")), tag("type", F.col("type")),
        F.lit("<required>true</required></column>"),
    )

    def listed(is_partition):
        item = F.when(F.col("is_partition") == is_partition, F.struct("ordinal", column.alias("x")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]), "")

    documents_of = lake.new_columns.groupBy("table_name").agg(
        F.concat(
            F.lit("<businessObjectFormatCreateRequest><namespace>NS</namespace>"),
            tag("businessObjectDefinitionName", F.first("table_name")),
            F.lit("<businessObjectFormatUsage>PRC</businessObjectFormatUsage>"),
            F.lit("<businessObjectFormatFileType>TXT</businessObjectFormatFileType><partitionKey>TDATE</partitionKey><schema><columns>"),
            listed(False), F.lit("</columns><partitions>"), listed(True),
            F.lit("</partitions><nullValue></nullValue><delimiter>,</delimiter><escapeCharacter>\\</escapeCharacter>"),
            F.lit("</schema></businessObjectFormatCreateRequest>"),
        ).alias("value")
    )
    place = work_dir(lake.spark, "formats")
    # Documents of fifty tables share a file, below one root.
    shelf = F.floor(F.regexp_extract("table_name", "([0-9]+)", 1).cast("long") / 50)
    shelved = documents_of.groupBy(shelf.alias("shelf")).agg(
        F.concat(F.lit("<formats>"), F.listagg("value"), F.lit("</formats>")).alias("value")
    )
    shelved.repartition("shelf").write.option("maxRecordsPerFile", 1).partitionBy("shelf").text(place)
    return place


@query(
    "src7_format_registrations",
    "SELECT table_name AS object_name, is_partition, ordinal, name, type FROM new_columns",
    "new_columns",
)
def format_registrations(lake):
    read = documents.scan_format_columns(lake.spark, written_formats(lake))
    return read.select("object_name", "is_partition", "ordinal", "name", "type")


@query("src9_catalog_snapshot", "SELECT tbl_id, db_id, tbl_name FROM tables", "tables")
def catalog_snapshot(lake):
    folder = work_dir(lake.spark, "catalog")
    lake.tables.write.parquet(f"{folder}/tables")
    return catalog.scan_snapshot(lake.spark, folder, "tables")


# Queries on scanned objects --------------------------------------------------


@query(
    "flt1_date_and_symbol",
    f"""SELECT concat_ws(',', cast(date AS varchar), cast("order" AS varchar), cast(quantity AS varchar), cast(price AS varchar),
      coalesce(cast(volume AS varchar), 'null'), symbol, tdate) AS line FROM ({SQL})
    WHERE date = DATE '1998-08-01' AND (symbol LIKE 'A%' OR symbol LIKE 'N%')""",
)
def date_and_symbol(lake):
    rows = objects.on_dates(scanned(lake, written_text(lake)), "date", None, ["1998-08-01"])
    return text.rendered(rows.where("symbol like 'A%' or symbol like 'N%'"))


@query(
    "flt2_dates_in_order",
    f"""SELECT concat_ws('|', cast(date AS varchar), cast("order" AS varchar), symbol) AS line FROM ({SQL})
    WHERE date IN (DATE '1998-08-01', DATE '1998-08-02', DATE '1999-03-05')""",
)
def dates_in_order(lake):
    rows = objects.on_dates(
        scanned(lake, written_text(lake)), "date", None, ["1998-08-01", "1998-08-02", "1999-03-05"]
    )
    return text.rendered(rows.orderBy("date").select("date", "order", "symbol"), "|")


@query(
    "flt11_evaluation_time",
    "SELECT count(*) AS orders, true AS already_past FROM orders WHERE o_orderdate < now()",
)
def evaluation_time(lake):
    past = lake.orders.where(F.col("o_orderdate") < F.current_timestamp())
    return past.agg(F.count(F.lit(1)).alias("orders"), F.lit(True).alias("already_past"))


@query(
    "srt3_top_orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def top_orders(lake):
    return lake.orders.select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey"
    ).limit(10)


@query("srt2_ordered_by_date", "SELECT o_orderkey, cast(cast(o_orderdate AS date) AS varchar) AS day FROM orders")
def ordered_by_date(lake):
    return lake.orders.orderBy("o_orderdate").select(
        "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day")
    )


@query(
    "sch5_text_under_new_schema",
    f"""SELECT cast(date AS varchar) AS day, "order" AS order_id, quantity, price, coalesce(volume, -1) AS shares, symbol AS ticker,
      '' AS venue, tdate FROM ({SQL})""",
)
def text_under_new_schema(lake):
    """Old text files under new names and types and an added last column."""
    fields = [
        ("day", T.DateType()), ("order_id", T.LongType()), ("quantity", T.DoubleType()),
        ("price", T.DoubleType()), ("shares", T.LongType()), ("ticker", T.StringType()),
        ("venue", T.StringType()),
    ]
    declared = T.StructType([T.StructField(n, t) for n, t in fields])
    place = written_text(lake)
    read = objects.scan_delimited(
        lake.spark, place, declared, delimiter="|", null_token="\\N",
        partitions=T.StructType([DAY]), base_path=place,
    )
    return read.select(
        F.col("day").cast("string").alias("day"), "order_id", "quantity", "price",
        F.coalesce("shares", F.lit(-1).cast("long")).alias("shares"), "ticker",
        F.coalesce("venue", F.lit("")).alias("venue"), "tdate",
    )


@query(
    "agg6_manifest_reconciliation",
    """SELECT tdate, file, counted, CASE WHEN tdate LIKE '%-04' AND file = 'part-R.txt' THEN -1 WHEN tdate LIKE '%-03' THEN counted + 1 ELSE counted END AS declared,
      CASE WHEN tdate LIKE '%-04' AND file = 'part-R.txt' THEN 'undeclared' WHEN tdate LIKE '%-03' THEN 'mismatch' ELSE 'match' END AS state
    FROM (SELECT strftime(l_shipdate, '%Y-%m') AS tdate, concat('part-', l_returnflag, '.txt') AS file, count(*) AS counted FROM lineitem GROUP BY 1, 2)
    UNION ALL SELECT DISTINCT strftime(l_shipdate, '%Y-%m'), 'part-lost.txt', -1, 7, 'missing' FROM lineitem""",
)
def manifest_reconciliation(lake):
    """Lines of each file against the manifests of its partition, some of which are wrong."""
    place, keys = work_dir(lake.spark, "declared"), ["tdate", "file"]
    file = F.concat(F.lit("part-"), "l_returnflag", F.lit(".txt"))
    lines = lake.lineitem.select(
        F.col("l_orderkey").cast("string").alias("line"), F.date_format("l_shipdate", "yyyy-MM").alias("tdate"), file.alias("file")
    )
    lines.repartition("tdate").write.partitionBy(*keys).text(place)
    read = objects.scan_delimited(
        lake.spark, place, T.StructType().add("l_orderkey", "long"), nested=True, path_keys=keys
    )
    told = F.col("n") + F.when(F.col("tdate").endswith("-03"), 1).otherwise(0)
    kept = ~(F.col("tdate").endswith("-04") & (F.col("file") == "part-R.txt"))
    entry = F.struct(F.col("file").alias("fileName"), told.cast("string").alias("rowCount"))
    lost = F.array(F.struct(F.lit("part-lost.txt").alias("fileName"), F.lit("7").alias("rowCount")))
    manifests_at = work_dir(lake.spark, "promised")
    lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).groupBy(
        F.lit("NS").alias("namespace"), F.lit("LINES").alias("businessObjectDefinitionName"), F.lit("PRC").alias("businessObjectFormatUsage"),
        F.lit("TXT").alias("businessObjectFormatFileType"), F.lit("0").alias("businessObjectFormatVersion"),
        F.lit("TDATE").alias("partitionKey"), F.col("tdate").alias("partitionValue"),
    ).agg(F.concat(F.collect_list(F.when(kept, entry)), lost).alias("manifestFiles")).write.json(manifests_at)
    declared = documents.scan_manifests(lake.spark, manifests_at, False).select(
        F.col("partition_value").alias("tdate"), F.col("file_name").alias("file"), "row_count"
    )
    return profile.reconciled(profile.row_counts(read, keys), declared, keys).select(
        *keys, F.coalesce("counted", F.lit(-1).cast("long")).alias("counted"),
        F.coalesce("declared", F.lit(-1).cast("long")).alias("declared"), "state",
    )


@query(
    "agg6_storage_listing",
    """WITH files AS (SELECT strftime(l_shipdate, '%Y-%m') AS tdate, concat('part-', l_returnflag, '.txt') AS file,
        sum(length(cast(l_orderkey AS varchar)) + 1)::BIGINT AS size FROM lineitem GROUP BY ALL),
    told AS (SELECT *, CASE WHEN tdate LIKE '%-04' AND file LIKE '%-R.txt' THEN NULL WHEN tdate LIKE '%-03' THEN size + 1 ELSE size END AS declared FROM files)
    SELECT tdate, file, size AS file_size, coalesce(declared, -1) AS declared_size,
      CASE WHEN declared IS NULL THEN 'extra' WHEN declared <> size THEN 'resized' ELSE 'same' END AS state FROM told
    UNION ALL SELECT DISTINCT tdate, 'part-lost.txt', -1, 7, 'missing' FROM files
    UNION ALL SELECT DISTINCT tdate, 'part-bare.txt', 0, 9, 'empty' FROM files""",
)
def storage_listing(lake):
    """Files below an object's root by name and size against what was declared, some of it wrong; none is opened."""
    place, keys = work_dir(lake.spark, "stored"), ["tdate", "file"]
    file = F.concat(F.lit("part-"), "l_returnflag", F.lit(".txt"))
    lines = lake.lineitem.select(
        F.col("l_orderkey").cast("string").alias("line"), F.date_format("l_shipdate", "yyyy-MM").alias("tdate"), file.alias("file")
    )
    months = lines.select("tdate").distinct()
    bare = months.select(F.lit(None).cast("string").alias("line"), "tdate", F.lit("part-bare.txt").alias("file"))
    # One file in each folder; a null line leaves its file empty.
    lines.repartition("tdate").write.partitionBy(*keys).text(place)
    bare.write.mode("append").partitionBy(*keys).option("emptyValue", "").option("header", "false").csv(place)
    sizes = lines.groupBy(*keys).agg(F.sum(F.length("line") + 1).alias("file_size"))
    told = sizes.where(~(F.col("tdate").endswith("-04") & (F.col("file") == "part-R.txt"))).withColumn(
        "file_size", F.col("file_size") + F.when(F.col("tdate").endswith("-03"), 1).otherwise(0)
    )
    for name, size in (("part-lost.txt", 7), ("part-bare.txt", 9)):
        told = told.unionByName(months.select("tdate", F.lit(name).alias("file"), F.lit(size).cast("long").alias("file_size")))
    found = listing.file_differences(listing.scan_listing(lake.spark, place, keys), told, keys)
    return found.select(
        *keys, *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("file_size", "declared_size")], "state"
    )


# Sinks ---------------------------------------------------------------------


def fresh(label):
    return f"{label}_{uuid.uuid4().hex[:12]}"


def leaving(lake, df, *tables):
    """`df` written out, so that the tables it reads need not stay in the catalog."""
    kept = stable(df)
    for name in tables:
        sinks.drop_object(lake.spark, name)
    return kept


@query("snk1_create_and_insert", "SELECT o_orderkey AS my_id, o_orderpriority AS my_string FROM orders UNION ALL SELECT c_custkey, c_name FROM customer")
def create_and_insert(lake):
    name, schema = fresh("inserted"), T.StructType().add("my_id", "long").add("my_string", "string")
    sinks.create_table(lake.spark, name, schema, work_dir(lake.spark, name))
    sinks.insert(lake.orders.select("o_orderkey", "o_orderpriority"), name)
    sinks.insert(lake.customer.select("c_custkey", "c_name"), name)
    return leaving(lake, lake.spark.table(name), name)


@query("snk2_create_as_select", "SELECT 10::BIGINT AS rows, true AS known FROM region LIMIT 1")
def create_as_select(lake):
    name = fresh("selected")
    sinks.create_table_as(lake.orders, name, work_dir(lake.spark, name), limit=10)
    known = lake.spark.table(name).join(lake.orders.select("o_orderkey"), "o_orderkey", "left_semi")
    counted = known.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) == 10).alias("known"))
    return leaving(lake, counted, name)


@query(
    "snk3_table_formats",
    "SELECT 'orc' AS format, c_custkey, c_mktsegment FROM customer UNION ALL SELECT 'csv', c_custkey, c_mktsegment FROM customer",
)
def table_formats(lake):
    read = None
    for file_format in ("orc", "csv"):
        name = fresh(file_format)
        rows = lake.customer.select("c_custkey", "c_mktsegment")
        sinks.create_table(lake.spark, name, rows.schema, work_dir(lake.spark, name), file_format)
        sinks.insert(rows, name)
        part = leaving(lake, lake.spark.table(name).select(F.lit(file_format).alias("format"), "*"), name)
        read = part if read is None else read.unionByName(part)
    return read


@query(
    "snk4_delete_rows",
    """SELECT kind, o_orderkey, o_orderstatus FROM orders, (VALUES ('plain'), ('partitioned'), ('text')) kinds(kind)
    WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 300000)""",
)
def delete_rows(lake):
    """Rows deleted from a plain table, a partitioned one and delimited text with its own separator."""
    rows = lake.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    gone, read = (F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 300000), None
    for kind, how in (("plain", {}), ("partitioned", {"partition_columns": ["o_orderstatus"]}), ("text", {"file_format": "csv", "sep": "|"})):
        name = fresh("thinned")
        sinks.create_table(lake.spark, name, rows.schema, work_dir(lake.spark, name), **how)
        sinks.insert(rows, name)
        deletes.delete_rows(lake.spark, name, gone)
        kept = leaving(lake, lake.spark.table(name).select(F.lit(kind).alias("kind"), "o_orderkey", "o_orderstatus"), name)
        read = kept if read is None else read.unionByName(kept)
    return read


@query(
    "snk5_dropped_objects",
    """SELECT r.* FROM (SELECT DISTINCT regexp_replace(namespace, '[. -]', '_', 'g') AS database_name,
        regexp_replace(concat(object_name, '_', usage_code, '_', kind), '[. -]', '_', 'g') AS table_name
        FROM notifications, (VALUES ('ORC'), ('TXT'), ('BZ')) kinds(kind)) r
    WHERE NOT EXISTS (SELECT 1 FROM notifications n WHERE wf_type = 7 AND regexp_replace(namespace, '[. -]', '_', 'g') = r.database_name
      AND regexp_replace(concat(coalesce(CASE WHEN json_valid(correlation_data) THEN coalesce(correlation_data ->> '$.businessObject.original_object_name',
        correlation_data ->> '$.businessObject.late_reporting_for') END, object_name), '_', usage_code, '_', file_type), '[. -]', '_', 'g') = r.table_name)""",
    "notifications",
)
def dropped_objects(lake):
    # Every object is registered in three formats; items drop it in one.
    kinds = F.explode(F.array(F.lit("ORC"), F.lit("TXT"), F.lit("BZ")))
    registry = lake.notifications.withColumn("kind", kinds).select(
        names.database_name(F.col("namespace")).alias("database_name"),
        names.sanitised(F.concat_ws("_", "object_name", "usage_code", "kind")).alias("table_name"),
    ).distinct()
    return sinks.without_dropped(registry, lake.notifications)


@query("snk6_databases", "SELECT DISTINCT regexp_replace(namespace, '[. -]', '_', 'g') AS name FROM notifications", "notifications")
def created_databases(lake):
    """Databases of all namespaces; their number is the number of namespaces."""
    wanted = stable(lake.notifications.select(names.database_name(F.col("namespace")).alias("name")).distinct())
    before = lake.spark.sql("SHOW DATABASES").select(F.col("namespace").alias("name"))
    made = [row.name for row in wanted.join(before, "name", "left_anti").toLocalIterator()]
    for name in made:
        sinks.create_database(lake.spark, name)
    listed = lake.spark.sql("SHOW DATABASES").select(F.col("namespace").alias("name"))
    found = stable(listed.join(wanted, "name", "left_semi"))
    for name in made:
        lake.spark.sql(f"DROP DATABASE `{name}`")
    return found


@query(
    "snk7_appended_items",
    "SELECT id, 0 AS wf_type FROM notifications UNION ALL SELECT id, 8 FROM notifications WHERE wf_type = 8",
    "notifications",
)
def appended_items(lake):
    place = work_dir(lake.spark, "items")
    sinks.append_items(lake.notifications.select("id", F.lit(0).alias("wf_type")), place)
    sinks.append_items(lake.notifications.where("wf_type = 8").select("id", "wf_type"), place)
    return lake.spark.read.parquet(place)


@query(
    "agg5_catalog_statistics",
    "\nUNION ALL\n".join(
        f"SELECT '{column}' AS column_name, '{measure}' AS measure, cast({value.format(column)} AS varchar) AS value FROM orders"
        for columns, measures in (
            (("o_orderkey", "o_custkey"), {"min": "min({})", "max": "max({})"}),
            (("o_orderstatus", "o_orderpriority"), {"max_col_len": "max(length({}))"}),
            (("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), {"num_nulls": "count(*) - count({})"}),
        )
        for column in columns for measure, value in measures.items()
    ),
)
def catalog_statistics(lake):
    """The profile as the catalog keeps it; its distinct counts are estimates and left out."""
    name = fresh("analyzed")
    sinks.create_table_as(lake.orders, name, work_dir(lake.spark, name))
    columns = lake.orders.columns
    sinks.analyze(lake.spark, name, columns)
    found = catalog.table_statistics(lake.spark, name, columns)
    # Bounds of whole numbers and lengths of texts; others are spelled in the engine's own way.
    kept = """measure = 'num_nulls' or (measure in ('min', 'max') and column_name in ('o_orderkey', 'o_custkey'))
      or (measure = 'max_col_len' and column_name in ('o_orderstatus', 'o_orderpriority'))"""
    return leaving(lake, found.where(kept), name)


@query(
    "prt1_partitions_of_a_table",
    "SELECT o_orderkey, o_custkey, o_orderpriority AS priority FROM orders",
)
def partitions_of_a_table(lake):
    """An external table whose partitions lie in folders of their own."""
    name, root = fresh("parted"), work_dir(lake.spark, "parted")
    rows = lake.orders.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("priority"))
    rows.write.partitionBy("priority").parquet(root)
    sinks.create_table(lake.spark, name, rows.schema, root + "-table", "parquet", ["priority"])
    parts = rows.select("priority").distinct().select(
        F.format_string("priority='%s'", "priority").alias("spec"),
        F.concat(F.lit(root + "/priority="), "priority").alias("location"),
    )
    sinks.add_partitions(lake.spark, name, parts)
    sinks.add_partitions(lake.spark, name, parts)
    return leaving(lake, lake.spark.table(name), name)


# Streams -------------------------------------------------------------------


EVERY_CHANGE = """changes AS (SELECT concat('DB', cast(c_nationkey AS varchar)) AS namespace, concat('u', cast(c_custkey AS varchar)) AS user_id FROM customer)"""


@query(
    "stm2_permission_stream",
    f"WITH {access_queries.NAMED}, {access_queries.READERS}, {EVERY_CHANGE}, {access_queries.DELTA} SELECT * FROM delta",
    "databases tables permission_lists grants",
)
def permission_stream(lake):
    """Messages on the customers' own namespaces; the answer is the delta of all of them."""
    place, sink = work_dir(lake.spark, "messages"), work_dir(lake.spark, "grants")
    lake.customer.select(
        F.to_json(
            F.struct(
                F.lit("delta_sync").alias("action"),
                F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("userId"),
                F.concat(F.lit("DB"), F.col("c_nationkey").cast("string")).alias("namespace"),
            )
        ).alias("value")
    ).unionByName(
        # Messages without a namespace change nothing.
        lake.customer.select(F.to_json(F.struct(
            F.lit("delta_sync").alias("action"),
            F.when(F.col("c_custkey") % 2 == 0, "*").otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string"))).alias("userId"),
        )).alias("value"))
    ).write.text(place)
    started = permissions.start_permission_sync(
        lake.spark.readStream.text(place),
        lambda: lake.permissions,
        lambda: access.tables_by_name(lake.databases, lake.tables),
        lambda: lake.grants,
        sink,
        work_dir(lake.spark, "sync"),
    )
    started.awaitTermination()
    return lake.spark.read.parquet(sink).drop("batch", "privilege")


@query("stm5_pending_refresh", work_queries.shown_sql(work_queries.LOAD_SQL), work_queries.WORK)
def pending_refresh(lake):
    """Eligible work written once for all changes of the log there are."""
    sink = work_dir(lake.spark, "pending")
    started = refresh.start_refresh(
        lake.streamed("processing_log", "lineitem"),
        lambda number: work_queries.listed(work_queries.eligible(lake)),
        sink,
        work_dir(lake.spark, "refresh"),
    )
    started.awaitTermination()
    return lake.spark.read.parquet(sink).drop("batch")


@query("stm5_refresh_until_idle", work_queries.shown_sql(work_queries.LOAD_SQL), work_queries.WORK)
def refresh_until_idle(lake):
    """The same at an interval, by a query that stops when three triggers found nothing new."""
    sink, checkpoint = work_dir(lake.spark, "pending"), work_dir(lake.spark, "refresh")
    changes = lake.streamed("processing_log", "lineitem")
    pending = lambda number: work_queries.listed(work_queries.eligible(lake))
    idle.run_until_idle(lake.spark, lambda trigger: refresh.start_refresh(changes, pending, sink, checkpoint, **trigger), 1.0, 3)
    return lake.spark.read.parquet(sink).drop("batch")

