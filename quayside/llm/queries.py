"""One query for each operator of this folder, over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import (
    fm_index,
    labelled,
    lexical_search,
    line_runs,
    metric_tree,
    mixing,
    ngram_join,
    pitman_yor,
    simhash_benchmark,
    source_divergence,
    subword_quality,
    token_records,
    toxicity_crf,
    url_rules,
)
from quayside.llm.common import table, tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(tuned(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_token_records")
def token_records_query(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as framed token ids, written and read back."""
    return token_records.token_digest(table(spark, folder, "documents"))


@query("op4_source_mixing", mixing.ORACLE)
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed by source, weights 5, 2, 1, repeated three times at most."""
    return mixing.mixture_report(table(spark, folder, "documents"))


@query("op5_toxicity_crf")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by the random field."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    field = toxicity_crf.train_field(docs, table(spark, folder, "labels"))
    return toxicity_crf.score_toxicity(docs, field).select(
        "doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= toxicity_crf.THRESHOLD).cast("int").alias("predicted"),
        F.col("_spans").alias("spans"),
    )


@query("op7_subword_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by subword embeddings."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = subword_quality.train_subwords(docs, table(spark, folder, "labels"))
    return subword_quality.score_quality(docs, model).select(
        "doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= subword_quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op6_ngram_join", ngram_join.ORACLE)
def ngram_groups(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in groups linked by a Jaccard similarity of 0.75 of five-word shingles."""
    return ngram_join.similar_documents(table(spark, folder, "documents").select("doc_id", "text"))


@query("op10_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of all documents that are similar to a benchmark item."""
    return simhash_benchmark.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_mtree_search", metric_tree.ORACLE)
def mtree_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth embedding against all others."""
    return metric_tree.top_scores(table(spark, folder, "embeddings"))


@query("op9_substring_dedup", fm_index.ORACLE)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the words of 50-word windows that smaller documents hold."""
    return fm_index.substring_dedup(table(spark, folder, "documents").select("doc_id", "text"))


@query("op3_line_runs", line_runs.ORACLE)
def line_runs_query(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without later copies of runs of two lines or more."""
    return line_runs.line_dedup(table(spark, folder, "documents").select("doc_id", "text"))


@query("op2_pitman_yor")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by the hierarchical Pitman-Yor model of nine tenths of them."""
    return pitman_yor.score_texts(table(spark, folder, "documents"))


@query("op11_hybrid_search", lexical_search.ORACLE)
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 documents of all that rank highest for each benchmark item."""
    return lexical_search.top_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_source_divergence", source_divergence.ORACLE)
def source_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The word use of each source of all documents against its language and the other sources."""
    return source_divergence.divergence(table(spark, folder, "documents"))


@query("op13_url_rules", url_rules.ORACLE)
def page_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All pages judged by rules on the hosts and paths of their URLs."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    found = url_rules.judged(pages, url_rules.rule_table(spark))
    return found.select("row.page_id", "host", "path", "rule", "verdict")
