"""From documents to token records: five stages, each on all rows the one before kept.

`STAGES` lists name and function; a function takes the session, documents and the
folder of the given tables and returns a DataFrame. `run` writes each result to
the shared folder and reads it again for the next stage. All stages but the last
return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import mixing, ngram_join, simhash_benchmark, token_records, toxicity_crf
from quayside.llm.common import free_name, table, tuned, written
from quayside.operators.ordering import numbered
from quayside.session import work_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the random field scores below its threshold."""
    tuned(spark)
    field = toxicity_crf.train_field(docs, table(spark, folder, "labels"))
    scored = toxicity_crf.score_toxicity(docs, field)
    score = F.col(f"`{free_name(docs, '_score')}`")
    return scored.where(score < toxicity_crf.THRESHOLD).select(*_own(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The smallest id of each group of similar documents; of repeated rows one. Rows without an id stay.

    An id that repeats with different texts names several documents, each of which is
    kept or dropped by its own text; the least hash of a text comes first.
    """
    tuned(spark)
    texts = docs.where("doc_id is not null").select("doc_id", _text_key().alias("text_key"))
    hashed = texts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("text_key").alias("low"), F.max("text_key").alias("high")
    )
    repeated = written(hashed.where("n > 1"), "repeated")
    if repeated.isEmpty():
        return docs.join(_later(docs.select("doc_id", "text")), "doc_id", "left_anti").select(*_own(docs))
    if repeated.where("low != high").isEmpty():
        kept = docs.join(_later(docs.select("doc_id", "text")), "doc_id", "left_anti")
        again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return kept.join(repeated, "doc_id", "left_anti").unionByName(again).select(*_own(docs))
    # Some ids have several texts: every distinct text of an id gets a number, in order of the ids.
    number, key = free_name(docs, "_number"), free_name(docs, "_text_key")
    named = numbered(texts.distinct(), [F.col("doc_id"), F.col("text_key")], number)
    placed = written(
        docs.withColumn(key, _text_key()).join(named.withColumnRenamed("text_key", key), ["doc_id", key], "left"), "numbered"
    )
    kept = placed.join(_later(placed.select(F.col(number).alias("doc_id"), "text")).withColumnRenamed("doc_id", number), number, "left_anti")
    without = kept.where(F.col(number).isNull())
    return without.unionByName(kept.where(F.col(number).isNotNull()).dropDuplicates([number])).select(*_own(docs))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNull())


def _later(docs: DataFrame) -> DataFrame:
    """Ids that are not the smallest of their group."""
    members = ngram_join.similar_documents(docs).where("doc_id is not null and component_id != doc_id")
    return written(members.select("doc_id").distinct(), "later")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage similar to a benchmark item."""
    tuned(spark)
    return simhash_benchmark.decontaminated(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    tuned(spark)
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token records of what is left, written and read back."""
    tuned(spark)
    return token_records.token_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources", mix_sources),
    ("token records", write_tokens),
]

# A fitted random field and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
