"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan here relies on; each can be set on a live session.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A key holding a third of a join's rows is split at run time, even where
    # that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Tables of the lake: exchanges are cut finely and put together again by size, so what
# one task holds depends neither on the input nor on `spark.sql.shuffle.partitions`.
GRAIN = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.files.openCostInBytes": "128k",  # a task takes hundreds of small files
}


def new_session(app: str = "quayside", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else started."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def tune_tables(spark: SparkSession) -> SparkSession:
    """As `tune`, with exchanges and scans in pieces of bounded size."""
    for key, value in GRAIN.items():
        spark.conf.set(key, value)
    return tune(spark)


def tune_texts(spark: SparkSession) -> SparkSession:
    """As `tune`, without the grain of an earlier `tune_tables`."""
    for key, value in GRAIN.items():
        if spark.conf.get(key, None) == value:
            spark.conf.unset(key)
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, which every executor must see.

    Where it is unset, a local session gets a folder of its own, removed when Python
    ends; a cluster must name one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="quayside-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def work_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, and read again with its own schema.

    Readers prune columns and filter; partitions and order are the reader's.
    """
    path = work_dir(df.sparkSession, "stable")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable_in_place(df: DataFrame) -> DataFrame:
    """As `stable`, with partitions and the order inside them as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
