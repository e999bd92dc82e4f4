"""Pages allowed or blocked by rules on hosts and paths of their URLs.

A rule names a host and the beginning of a path; it fits the host, all its
subdomains, and every path that begins so. Each URL is spelled out as the
expressions a rule could have written: ends of its host, whole labels each, with
beginnings of its path, in those lengths that rules have. Expressions and rules
meet at the first four bytes of their SHA-256, an equi-join; the whole digest
confirms a meeting, and of the confirmed rules the longest decides.

What a URL gets depends on its host and path alone, so those are judged once
each, however many rows repeat them; pages are joined to the outcome. Rules are
broadcast only where Spark finds them small. The lengths that rules have are one
value for all tasks: a pair of two numbers per length, not per rule.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import LOWER, UPPER

PREFIX_BYTES = 4
DEFAULT = "allow"
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules written in code, as a table: `host`, `path`, `verdict`."""
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), rule)]) for rule in rules]
    if not rows:
        return spark.createDataFrame([], "host string, path string, verdict string")
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    """Behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _known(rules: DataFrame) -> DataFrame:
    """Rules by expression; of rules with one expression a block counts."""
    host = F.translate(F.col("host").cast("string"), UPPER, LOWER)
    expression = F.concat(host, F.coalesce(F.col("path").cast("string"), F.lit("")))
    named = rules.select(host.alias("host"), expression.alias("rule"), F.col("verdict").cast("string").alias("verdict"))
    named = named.where("host != '' and verdict in ('allow', 'block')")
    return named.groupBy("host", "rule").agg(F.max("verdict").alias("verdict")).select(
        "rule", "verdict",
        _labels(F.col("host")).alias("labels"),
        F.length("host").alias("host_length"),
        (F.length("rule") - F.length("host")).alias("chars"),
        F.unhex(F.sha2("rule", 256)).alias("digest"),
    )


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """`row` (the caller's whole row), `host`, `path`, `rule` and `verdict` of each page.

    `rules` has `host`, `path` and `verdict` (allow or block). The longest fitting rule
    wins; of two as long the one with the longer host, of two alike the block. Without
    one, `rule` is null and the verdict `default`. Null, empty and odd URLs have an
    empty host and path, which no rule fits. Rows that repeat stay. Rules without a host
    or with another verdict are left out; a rule without a path fits every path.
    """
    known = _known(rules)
    lengths = known.agg(F.sort_array(F.collect_set(F.struct("labels", "chars"))).alias("lengths")).scalar()
    given = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    address = given["row"][url].cast("string")
    placed = given.select("row", host_of(address).alias("host"), path_of(address).alias("path"))

    host, path = F.col("host"), F.col("path")
    fits = lambda s: (s["labels"] <= _labels(host)) & (s["chars"] <= F.length(path))
    spelled = lambda s: F.concat(
        F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.substring(path, F.lit(1), s["chars"])
    )
    sites = placed.select("host", "path").distinct().withColumn("lengths", lengths)
    asked = sites.select(
        "host", "path", F.explode(F.transform(F.filter("lengths", fits), spelled)).alias("expression")
    ).select("host", "path", F.unhex(F.sha2("expression", 256)).alias("asked"))
    met = asked.withColumn("prefix", F.substring("asked", 1, PREFIX_BYTES)).join(
        known.withColumn("prefix", F.substring("digest", 1, PREFIX_BYTES)), "prefix"
    )
    order = F.struct(F.length("rule").alias("length"), "host_length", "verdict", "rule")
    # Confirmed inside the aggregate: as a filter it would become a key of the join.
    best = met.groupBy("host", "path").agg(F.max(F.when(F.col("asked") == F.col("digest"), order)).alias("best"))
    return placed.join(best, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


ORACLE = r"""
WITH placed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules (h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM placed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) = 1
"""
