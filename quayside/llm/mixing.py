"""Mix sources to target weights by repeating and drawing documents.

DataFrame functions only. Sizes are summed per source, with partial sums before
the shuffle, so a source that holds a third of the rows costs no more than
another. What a source's rows need is one row per source; Spark broadcasts that
table where its written size is below `spark.sql.autoBroadcastJoinThreshold`, and
else joins by sort and merge, splitting crowded sources at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import WORD, written
from quayside.operators.ordering import numbered

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = 17


def words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the seed and the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """`source`, `source_size`, `target` and `rate` of each source, from rows of `source` and `size`.

    The n-th source by code point, null last, has the n-th weight, repeating. The
    whole size is shared by weight; a target above `most` times its source's size
    stops there, and what is over is shared again among the rest until none is
    above. Each round is one sum over the sources and settles one of them at least.
    A source without any words has target 0 and rate 1.
    """
    totals = written(
        sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources"
    )
    repeating = F.array(*[F.lit(float(w)) for w in weights])
    placed = numbered(totals, [F.col("source").asc_nulls_last()], "_place")
    weighed = written(
        placed.select(
            "source", "source_size",
            F.element_at(repeating, ((F.col("_place") - 1) % len(weights) + 1).cast("int")).alias("_weight"),
        ),
        "weighed",
    )
    limit = F.col("source_size") * F.lit(float(most))
    level, stopped = 0.0, -1
    while True:
        # A source above the level of the round before has stopped for good.
        held = F.col("_weight") * F.lit(level) > limit
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(held, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(held, 0.0).otherwise(F.col("_weight"))).alias("weight"),
            F.sum(held.cast("long")).alias("stopped"),
        ).first()
        if not row["weight"] or row["stopped"] == stopped:
            break
        stopped = row["stopped"]
        level = (row["all"] - row["held"]) / row["weight"]
    target = F.least(F.col("_weight") * F.lit(float(level)), limit)
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(1.0)
    return weighed.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def mixture(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, carry: list[str] | None = None
) -> DataFrame:
    """`row` (the caller's columns, or those in `carry`), `size`, `source_size`, `target` and `copies` of each row.

    A document gets floor(rate) copies and one more with the fraction's
    probability, decided by a hash of its id. Rows that repeat get the same number
    of copies each; a null id draws as the empty text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns])
    sized = docs.select(row.alias("row"), F.col("source").alias("own"), F.col("doc_id").alias("id"), words(F.col("text").cast("string")).alias("size"))
    shares = source_targets(sized.select(F.col("own").alias("source"), "size"), weights, most)
    joined = sized.join(written(shares, "shares"), F.col("own").eqNullSafe(F.col("source")))
    whole = F.floor("rate")
    extra = (draw(F.col("id"), seed) < F.col("rate") - whole).cast("long")
    return joined.select("row", "size", "source_size", "target", (whole + extra).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of `docs`, with its own columns, as often as it is taken."""
    copies = F.array_repeat(F.lit(True), F.col("copies").cast("int"))
    return mixture(docs, weights, most, seed).select("row", F.explode(copies)).select("row.*")


def mixture_report(docs: DataFrame, **how) -> DataFrame:
    """`doc_id`, `size`, `source_size`, `target`, `taken` of each row."""
    return mixture(docs, carry=["doc_id"], **how).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS total,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM sized GROUP BY source),
-- Filled level by level: in order of limit per weight, the sources in front have stopped.
filling AS (
  SELECT *, 3 * total / w AS brim,
         coalesce(sum(3 * total) OVER (ORDER BY 3 * total / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY 3 * total / w DESC, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rest,
         sum(total) OVER () AS everything
  FROM sources),
level AS (SELECT coalesce(arg_min((everything - held) / rest, brim) FILTER (WHERE (everything - held) / rest <= brim), max(brim)) AS water FROM filling),
shares AS (
  SELECT source, total::BIGINT AS source_size, least(w * water, 3 * total) AS target,
         CASE WHEN total > 0 THEN least(least(w * water, 3 * total) / total, 3.0) ELSE 1.0 END AS rate
  FROM filling, level)
SELECT d.doc_id, d.size, s.source_size, s.target,
       d.size * (floor(s.rate)::BIGINT + CASE WHEN
         ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
         < s.rate - floor(s.rate) THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
"""
