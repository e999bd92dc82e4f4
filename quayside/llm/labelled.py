"""The labelled rows a classifier is fitted on, and its held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import remainder

FOLDS = 5


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return remainder(doc_id, folds) == 0


def training_texts(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int, folds: int = FOLDS
) -> DataFrame:
    """`text` and `label` (0 or 1) of at most `rows` labelled documents outside the held-out fold.

    They are the ones whose ids hash lowest, so a rerun takes the same. Texts of
    more than `longest` bytes are not fitted on. Ids and labels that are null are
    left out; of several labels of one id the largest counts. The chosen ids are at
    most `rows`, which bounds their broadcast.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .where(~held_out(F.col("_id"), folds))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).where(
        F.octet_length("text") <= longest
    )
    return texts.join(F.broadcast(chosen), "_id").select("text", "label", "_id")
