"""Repeated runs of lines, found by prefix doubling, and texts without their later copies.

DataFrame functions only. A line's id is a hash of 128 bits. Names of suffixes by
their first 2^k lines come from names by their first 2^(k-1): the pair of a
suffix's name and the name 2^(k-1) lines further on is ranked among all pairs, in
order, so names sort as the lines do. Only suffixes whose first lines occur twice
stay for the next round; the rounds are as many as the logarithm of the longest
repeated run. Suffixes of one name are an interval of the suffix array whose
longest common prefix is 2^k lines at least; the interval's first suffix by
document and place is the original.

Each later suffix is aligned with the original of its deepest interval; stretches
of neighbouring suffixes with one alignment are the maximal repeated runs.

A name may be shared by a third of all lines: names and originals are aggregates
with partial sums, and the joins that bring them back are ones Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import WORD, written
from quayside.operators.ordering import numbered

LEAST_LINES = 1

_PLACE = ["doc_id", "text_key", "pos"]


def _named(rows: DataFrame, key: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose `key` occurs more than once, with its rank as `name` and its first place as `first`."""
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*_PLACE)).alias("first")).where("_n > 1")
    ranked = numbered(groups.drop("_n"), [F.col(k) for k in key], "name")
    return written(rows.join(ranked, key).select(*_PLACE, "name", "first", *carry), "names")


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: suffixes whose first 2^k lines occur more than once, with `name` and `first`.

    `lines` has `doc_id`, `text_key`, `pos`, the line's hashes `h1`, `h2`, and `worded`,
    which the first level keeps.
    """
    levels = [_named(lines, ["h1", "h2"], ("worded",))]
    while not levels[-1].isEmpty():
        step = 1 << (len(levels) - 1)
        ahead = Window.partitionBy("doc_id", "text_key").orderBy("pos").rangeBetween(step, step)
        pairs = levels[-1].select(*_PLACE, F.col("name").alias("r1"), F.max("name").over(ahead).alias("r2"))
        levels.append(_named(written(pairs.where("r2 is not null"), "pairs"), ["r1", "r2"]))
    return levels[:-1]


def repeated_runs(docs: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """Later copies of runs of `least` lines or more (a power of two).

    `docs` has `doc_id`, `text` and `text_key`. Gives `doc_id`, `text_key`, `begin`,
    `end` (lines), and where the original begins: `from_id`, `from_key`,
    `from_begin`. What comes first is the smaller id, then the smaller line number.
    Runs of different originals may overlap. Lines end at line feeds; an empty line
    is a line, but by itself, as any line without a word, it is no run. Null ids and
    null texts take no part.
    """
    if least < 1 or least & (least - 1):
        raise ValueError("least must be a power of two")
    lines = (
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select(*_PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                F.rlike("line", F.lit(WORD)).alias("worded"))
    )
    levels = suffix_levels(lines)[least.bit_length() - 1 :]
    later = None
    for k, level in enumerate(levels):
        # Only the first level has the column; a copied line without words goes within longer runs.
        level = level.where("worded") if least << k == 1 else level
        rows = level.where(F.struct(*_PLACE) != F.col("first")).select(
            *_PLACE, "first", F.lit(least << k).cast("long").alias("length"))
        later = rows if later is None else later.unionByName(rows)
    if later is None:
        later = lines.limit(0).select(*_PLACE, F.struct(*_PLACE).alias("first"), F.lit(0).cast("long").alias("length"))
    # The deepest interval a suffix is a later member of.
    deepest = later.groupBy(*_PLACE).agg(F.max(F.struct("length", "first")).alias("_m")).select(
        *_PLACE, F.col("_m.length").alias("length"), F.col("_m.first.doc_id").alias("from_id"),
        F.col("_m.first.text_key").alias("from_key"), (F.col("pos") - F.col("_m.first.pos")).alias("shift"),
    )
    lane = Window.partitionBy("doc_id", "text_key", "from_id", "from_key", "shift").orderBy("pos")
    before = lane.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("length")
    opens = F.coalesce((F.col("pos") > F.max(end).over(before)).cast("int"), F.lit(1))
    cut = deepest.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(lane))
    return cut.groupBy("doc_id", "text_key", "from_id", "from_key", "shift", "_run").agg(
        F.min("pos").cast("long").alias("begin"), F.max(end).alias("end")
    ).select(
        "doc_id", "text_key", "begin", "end", "from_id", "from_key", (F.col("begin") - F.col("shift")).alias("from_begin")
    )


def line_dedup(docs: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """`doc_id`, `n_lines`, `n_removed`, `kept_sha256` of each row: later copies of line runs are deleted.

    A null text has no lines and the digest of an empty text. Kept lines are joined
    by line feeds. Rows that repeat have the same result each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "text_key", F.xxhash64("text")
    )
    # Runs of one text that meet or overlap become one, so that what is left lies between two neighbours.
    along = Window.partitionBy("doc_id", "text_key").orderBy("begin", "end")
    opens = F.coalesce((F.col("begin") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    apart = (
        repeated_runs(rows, least).select("doc_id", "text_key", "begin", "end").withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(along))
        .groupBy("doc_id", "text_key", "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    )
    spans = written(
        apart.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans")), "line-spans"
    )
    plain = rows.select(
        "doc_id", "text_key", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"),
    ).withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
    lines = F.split("text", "\n", -1)
    fronts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    backs = F.concat(F.col("spans.begin"), F.array(F.size(lines).cast("long")))
    between = F.transform(
        F.arrays_zip(fronts.alias("a"), backs.alias("b")), lambda g: F.slice("_lines", (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))
    )
    cut = written(
        # Sorted and merged at any size: the spans grow with the documents.
        rows.join(spans.hint("merge"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).withColumn("_lines", lines)
        .withColumn("_kept", F.flatten(between)).select(
            "doc_id", "text_key", (F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
            F.sha2(F.array_join("_kept", "\n"), 256).alias("cut_sha256"),
        ), "cut-lines",
    )
    return plain.join(cut, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
    )


ORACLE = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
pairs AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1
    AND regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS alone, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM lines),
-- A line with words that was there earlier goes; a pair of neighbouring lines that was takes both of its lines.
later AS (
  SELECT doc_id, pos, alone, next IS NOT NULL AND row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) > 1 AS copy
  FROM pairs),
gone AS (
  SELECT *, alone OR copy OR coalesce(lag(copy) OVER (PARTITION BY doc_id ORDER BY pos), FALSE) AS gone FROM later),
texts AS (
  SELECT l.doc_id, count(*) AS n_lines, sum(g.gone::INT)::BIGINT AS n_removed,
         sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE NOT g.gone), '')) AS kept_sha256
  FROM lines l JOIN gone g USING (doc_id, pos) GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, kept_sha256 FROM texts
UNION ALL
SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
