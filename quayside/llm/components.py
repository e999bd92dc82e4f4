"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """`id` and `component` (its smallest reachable id) of each id in `links` (`a`, `b`, longs).

    Large and small stars in turn: each id's neighbours are hung onto the smallest
    of them, first those above the id, then those below, until nothing moves. Only
    minima and joins; a hub's neighbours are never gathered into one row. Rounds
    grow with the logarithm of a component's size. Loops and repeated links change
    nothing; an empty table has no components.
    """
    links = links.where("a != b")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    while state[0]:
        # Large star: for every u, neighbours above u go to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "large-star")
        # Small star: for every u, it and its neighbours below go to the smallest of these.
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            below.select("u", F.col("m").alias("v"))
        )
        edges = written(small.where("u != v").distinct(), "small-star")
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("u")).distinct()
    return edges.unionByName(roots.select("u", F.col("u").alias("v"))).select(
        F.col("u").alias("id"), F.col("v").alias("component")
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
