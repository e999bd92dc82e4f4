"""Documents whose word shingles are similar, by prefixes that several tokens must share.

The set of a document is its distinct shingles. Tokens are ordered by how many
documents hold them, as far as that was counted, rare ones first. Of two similar
sets of n and m tokens, the first n - ceil(tn) + l of one and m - ceil(tm) + l of
the other share l tokens at least, for any l. Each document takes the l whose
estimated cost is least: a longer prefix costs rows, a frequent token in it costs
candidates, and l tokens in common are rarer than one. A pair is a candidate if
its prefixes share as many tokens as the smaller l of both, and as many as its
sizes ask for beyond what can still be shared behind the prefixes; candidates
are verified on their whole sets.

Copies would make all pairs of their group candidates, so they go first. Equal
sets stand for one another. Then each set is verified against one other, the one
that comes first for most of its prefix tokens, which gathers near copies around
few of them; what is linked already needs no verifying, so candidates are
searched between groups only. Links within a group are found or implied. The
search meets pairs at tokens behind which both still have as many as they must
share, which are the rare ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import asked_rows, grams, mix, slices, words_of, written
from quayside.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
PERCENT = 75
FREQUENT = 1 << 18  # tokens whose frequency the order and the costs know; a bound for their table
COUNTED = 2_500_000  # tokens of documents that are counted together
SEEN = 2  # documents among them, for a token to be counted as frequent
MOST_SHARED = 4

_TOKENS = "token long, doc_id long, n_shingles long, matches int"
_SETS = "doc_id long, n_shingles long, first_key long, second_key long, matches int, prefix binary"


def _sets(part: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each row; a text shorter than a shingle is one as a whole."""
    words = words_of(part["text"], True)
    hashes, room = words.hashes(), words.room()
    shingles = grams(hashes, size)
    bounds = words.first.tolist()
    for begin, end in zip(bounds, bounds[1:]):
        if end - begin >= size:
            yield np.unique(shingles[begin : end - size + 1])
        elif end > begin:
            # Of another length, so its hash is of another kind.
            yield grams(hashes[begin:end], end - begin)[:1]
        else:
            yield shingles[:0]


def frequent_tokens(docs: DataFrame, size: int = SHINGLE, limit: int = FREQUENT, seen: int = SEEN) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many documents hold, with about how many: only `seen` or more among COUNTED tokens at a time count.

    At most `limit` tokens, sorted. They steer the order of tokens and the choice of
    prefixes; results don't depend on them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.uint64)]

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= seen
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[many].view(np.int64)), pa.array(counts[many])], names=["token", "n"]
            )

        for part in slices(batches, "text"):
            held.append(np.concatenate([held[0][:0], *_sets(part, size)]))
            if sum(map(len, held)) >= COUNTED:
                yield counted()
                del held[1:]
        yield counted()

    got = (
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(count, "token long, n long")
        .groupBy("token").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token").limit(limit).toArrow()
    )
    tokens = got["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], got["n"].to_numpy()[order]


def _prefix(tokens: np.ndarray, percent: int, known: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """How many tokens must be shared, and the prefix for it, rare tokens first."""
    often = np.ones(len(tokens))
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        often = np.where(known[at] == tokens, counts[at], 1).astype(np.float64)
    order = np.lexsort((tokens, often))
    tokens, often = tokens[order], often[order]
    least = -(-percent * len(tokens) // 100)
    best, matches = None, 1
    met = np.cumsum(often - 1)  # other documents that the tokens so far bring
    for shared in range(1, min(MOST_SHARED, least) + 1):
        length = len(tokens) - least + shared
        # Of those met, at most one in `shared` can share that many tokens.
        cost = length + met[length - 1] / shared
        if best is None or cost < best:
            best, matches = cost, shared
    return matches, tokens[: len(tokens) - least + matches]


def document_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: size of its set, two hashes of the whole set, and its prefix."""
    known, counts = frequent_tokens(docs, size)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for tokens in _sets(part, size):
                first, second = (int(mix(tokens ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (11, 23))
                matches, prefix = _prefix(tokens, percent, known, counts) if len(tokens) else (0, tokens)
                rows.append((len(tokens), first, second, matches, prefix.tobytes()))
            n, first, second, matches, prefix = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.array(matches, pa.int32()), pa.array(prefix, pa.binary())],
                names=["doc_id", "n_shingles", "first_key", "second_key", "matches", "prefix"],
            )

    return docs.mapInArrow(describe, _SETS)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per prefix token."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            prefixes = [p.as_buffer() for p in part["prefix"]]
            counts = np.array([p.size // 8 for p in prefixes], dtype=np.int64)
            flat = np.frombuffer(b"".join(p.to_pybytes() for p in prefixes), np.int64)
            named = {c: np.repeat(part[c].to_numpy(), counts) for c in ("doc_id", "n_shingles", "matches")}
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), *[pa.array(v) for v in named.values()]], names=["token", *named]
            )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by token and id, of tokens that several ids hold, with the first id of each.

    A token's rows are never held together: its first row waits for a second, and
    later ones need the first id alone.
    """
    waiting, token, low = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens, ids = batch["token"].to_numpy(), batch["doc_id"].to_numpy()
        opens = np.concatenate([[token is None or tokens[0] != token], tokens[1:] != tokens[:-1]])
        group = np.cumsum(opens)  # 0: goes on from the batch before
        firsts = np.concatenate([[low if low is not None else 0], ids[opens]])
        lows = firsts[group]
        later = ids != lows
        if waiting is not None and later[group == 0].any():
            yield waiting
            waiting = None
        if opens.any():
            waiting = None
        several = np.bincount(group[later], minlength=len(firsts)) > 0
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(lows)], names=[*batch.schema.names, "low"])
        yield out.filter(pa.array(several[group] & (later | (group > 0))))
        token, low = tokens[-1], lows[-1]
        if group[-1] > 0 and not several[group[-1]]:
            waiting = out.slice(int(np.flatnonzero(opens)[-1]), 1)


def similar_pairs(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of `pairs` (`a`, `b`) whose whole sets are similar enough."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([s.tobytes() for s in _sets(part, size)], pa.binary())],
                names=["doc_id", "tokens"],
            )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch["x"], batch["y"])):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    found = asked_rows(texts, asked, "doc_id", gather, "doc_id long, tokens binary")
    sets = written(found, "asked-sets").dropDuplicates(["doc_id"])
    met = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b"
    )
    return met.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _needed(percent: int) -> Column:
    """Tokens that the prefixes of similar sets `_a`, `_b` share at least.

    Of the two, take the set whose prefix ends first in the order of tokens: what it
    shares inside its prefix the other's prefix holds as well, and behind it there
    are n - length tokens left. Either may be that one, so the smaller bound counts.
    """
    n_a, n_b = F.col("n_shingles_a"), F.col("n_shingles_b")
    overlap = F.ceil((n_a + n_b) * F.lit(percent) / F.lit(100 + percent))
    behind = [F.ceil(n * F.lit(percent) / 100) - m for n, m in ((n_a, F.col("matches_a")), (n_b, F.col("matches_b")))]
    return overlap - F.greatest(*behind)


def _lengths_fit(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _fronts(rows: DataFrame, percent: int) -> DataFrame:
    """Each `doc_id` with the `front` of most of its tokens, if they are more than a few."""
    most = F.struct(F.count(F.lit(1)).alias("n"), (-F.col("front")).alias("front"))
    counted = rows.groupBy("doc_id", "n_shingles", "matches", "front").agg(most.alias("most"))
    best = counted.groupBy("doc_id", "n_shingles", "matches").agg(F.max("most").alias("most"))
    # Few tokens in common are left to the search between groups.
    few = F.greatest(F.col("matches"), F.col("n_shingles") * ((100 - percent) / 400))
    return best.where(F.col("most.n") >= few).select((-F.col("most.front")).alias("a"), F.col("doc_id").alias("b"))


def _between(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of `shared` with their group as `part`: those of tokens that several groups hold."""
    parts = components(links).select(F.col("id").alias("doc_id"), F.col("component"))
    grouped = written(
        shared.join(parts, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component"),
        "grouped",
    )
    several = grouped.groupBy("token").agg(
        F.min("part").alias("from"), F.max("part").alias("to"), F.count(F.lit(1)).alias("held")
    ).where("from < to")
    return written(grouped.join(several.select("token", "held"), "token"), "open")


_END = ("doc_id", "n_shingles", "matches", "part", "rest")


def _ends(open_: DataFrame) -> DataFrame:
    """`open_` with `rest`: how many tokens of the document come from this one on, rare ones first.

    A document has no more of them than its prefix is long.
    """
    order = Window.partitionBy("doc_id").orderBy(F.desc("held"), F.desc("token"))
    return open_.withColumn("rest", F.row_number().over(order)).select("token", *_END)


def similar_groups(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of all documents, the links found between different sets, and groups of sets.

    Gives `doc_id`, `n_shingles`, `set_id` (smallest id with the same set; null for
    an empty set) per row; `a`, `b` of links between such ids; `set_id`,
    `component_id` of those that are linked. Ids name documents: rows of one id and
    different texts are taken as one where they are linked. Rows without an id take
    no part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(document_sets(rows, size, percent), "sets")
    key = ["n_shingles", "first_key", "second_key"]
    named = sets.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy(*key).agg(F.min("doc_id").alias("set_id"))
    # Equal sets have equal prefixes, so an aggregate carries one on and no row meets its class for it.
    heads = named.groupBy(*key).agg(
        F.min("doc_id").alias("doc_id"), F.any_value("matches").alias("matches"), F.any_value("prefix").alias("prefix")
    )
    tokens = heads.select("doc_id", "n_shingles", "matches", "prefix").mapInArrow(_spread, _TOKENS)
    # Tokens of one set only make no candidates; that is most of them.
    shared = written(
        tokens.repartition("token").sortWithinPartitions("token", "doc_id").mapInArrow(_met, f"{_TOKENS}, low long"),
        "shared",
    )
    # Gather: verify each set against the one in front of it in most of its tokens.
    near = _fronts(shared.where("low < doc_id").withColumnRenamed("low", "front"), percent)
    links = written(similar_pairs(written(near, "near"), rows, size, percent), "first-links")
    open_ = _between(shared.select("token", "doc_id", "n_shingles", "matches"), links)
    ends = written(_ends(open_), "ends")
    a = ends.select("token", *[F.col(c).alias(f"{c}_a") for c in _END])
    b = ends.select("token", *[F.col(c).alias(f"{c}_b") for c in _END])
    needed = F.greatest(F.least("matches_a", "matches_b"), _needed(percent))
    met = (
        a.join(b, "token")
        # The first token that a similar pair shares has the others behind it in both.
        .where((F.col("part_a") < F.col("part_b")) & _lengths_fit(F.col("n_shingles_a"), F.col("n_shingles_b"), percent)
               & (F.least("rest_a", "rest_b") >= needed))
        .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), needed.alias("needed")).distinct()
    )
    held = written(open_.groupBy("doc_id").agg(F.collect_list("token").alias("tokens")), "held")
    candidates = (
        met.join(held.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
        .join(held.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
        .where(F.size(F.array_intersect("x", "y")) >= F.col("needed")).select("a", "b")
    )
    more_links = written(similar_pairs(written(candidates, "candidates"), rows, size, percent), "more-links")
    links = links.unionByName(more_links)
    groups = components(links).select(F.col("id").alias("set_id"), F.col("component").alias("component_id"))
    members = sets.select("doc_id", *key).join(classes, key, "left").select("doc_id", "n_shingles", "set_id")
    return members, links, groups


def similar_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `n_shingles` and `component_id` of each row.

    `component_id` is the smallest id reachable by links; an empty set is linked
    with nothing. A null id has its own size and a null component.
    """
    members, _, groups = similar_groups(docs, size, percent)
    return members.join(groups, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "set_id", "doc_id").alias("component_id")
    )


ORACLE = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM listed WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * met >= 75 * (s.n + t.n - met)),
edges AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS c FROM listed UNION SELECT e.v, r.c FROM reached r JOIN edges e ON e.u = r.doc_id)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id
FROM listed l LEFT JOIN sizes s ON s.doc_id = l.doc_id JOIN reached r ON r.doc_id = l.doc_id GROUP BY l.doc_id, n
"""
