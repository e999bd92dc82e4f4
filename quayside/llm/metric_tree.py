"""Exact inner-product search by best-first search in M-trees.

Inner products become distances: a vector x gets one more component,
sqrt(M - |x|^2), where M is the largest squared length, and a query 0. Then
distance^2 = |q|^2 + M - 2 q.x, so the nearest are the highest scores.

Rows are spread over shards; each shard is an M-tree, in numpy arrays. A page
holds entries around a routing vector; an entry of an inner page keeps its
covering radius, and every entry its distance to the routing vector of its page.
Pages are visited in the order of their least possible distance. The distance
from the query to an entry is not computed if the stored distance to the page's
routing vector and the triangle inequality show that the entry can't matter.
Bounds are taken with a margin for rounding, scores are integers, and ties at the
last rank are kept until ids decide, so results are exact.

A row goes to its shard once, and the trees are written once. Queries, a twentieth of
the rows, go to all trees in blocks of bounded size, and the best of a query's shards
are merged; so what is shuffled grows with rows, and what each block reads is the trees.
"""

from __future__ import annotations

import heapq
import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import written
from quayside.session import work_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 64
NEIGHBOURS = 20
PAGE = 1024
SHARD_ROWS = 16384
QUERY_ROWS = 8192
QUERY_BYTES = 8 << 20
_FOUND = "query_id long, vec_id long, score long"
_MARGIN = 1e-6


@dataclass
class Page:
    """Entries of a node, with their distances `apart` from the page's routing vector.

    An inner page holds its children with their routing vectors and covering radii;
    a leaf holds vectors and ids.
    """

    routing: np.ndarray
    radius: float
    apart: np.ndarray
    children: list[Page]
    centres: np.ndarray
    radii: np.ndarray
    vectors: np.ndarray
    ids: np.ndarray


def build(points: np.ndarray, exact: np.ndarray, ids: np.ndarray, page: int = PAGE) -> Page:
    """An M-tree over all `points`, loaded top down; leaves keep `exact` vectors and `ids`.

    A node's vectors go to the nearest of some routing vectors, each chosen
    farthest from those before; where all are alike, they are cut by position.
    """

    def load(rows: np.ndarray, routing: np.ndarray) -> Page:
        apart = np.sqrt(((points[rows] - routing) ** 2).sum(axis=1))
        radius = float(apart.max()) if len(rows) else 0.0
        if len(rows) <= page:
            order = np.argsort(apart, kind="stable")
            return Page(routing, radius, apart[order], [], points[:0], apart[:0], exact[rows[order]], ids[rows[order]])
        heads = [int(rows[int(apart.argmax())])]
        near = np.full(len(rows), np.inf)
        owner = np.zeros(len(rows), dtype=np.int64)
        for k in range(min(page, -(-2 * len(rows) // page) + 1)):
            d = ((points[rows] - points[heads[k]]) ** 2).sum(axis=1)
            closer = d < near
            owner[closer], near[closer] = k, d[closer]
            heads.append(int(rows[int(near.argmax())]))
            if near.max() <= 0:
                break
        groups = [g for g in (rows[owner == k] for k in range(len(heads) - 1)) if len(g)]
        if len(groups) < 2:
            groups = np.array_split(rows, min(page, -(-len(rows) // page)))
        children = [load(g, points[g].mean(axis=0)) for g in groups]
        centres = np.stack([c.routing for c in children])
        between = np.sqrt(((centres - routing) ** 2).sum(axis=1))
        return Page(routing, radius, between, children, centres, np.array([c.radius for c in children]), exact[:0], ids[:0])

    return load(np.arange(len(points)), points.mean(axis=0))


def search(
    root: Page, longest: float, asked: np.ndarray, own: int, count: int
) -> tuple[list[tuple[int, int]], int]:
    """The `count` best (score, id) for `asked`, equal scores by smaller id, and distances computed.

    `asked` holds whole numbers; `longest` is the largest squared length of all vectors.
    """
    query = np.append(asked, 0).astype(float)
    constant = float((asked.astype(float) ** 2).sum()) + longest
    scores, names = np.zeros(0, dtype=asked.dtype), np.zeros(0, dtype=np.int64)
    reach = np.inf  # distance within which a vector may still count
    d = float(np.sqrt(((root.routing - query) ** 2).sum()))
    queue = [(max(0.0, d - root.radius), 0, d, root)]
    computed, tick = 1, 0
    while queue:
        bound, _, d, node = heapq.heappop(queue)
        if bound > reach:
            break
        if node.children:
            near = np.flatnonzero(np.abs(d - node.apart) - node.radii <= reach)
            distances = np.sqrt(((node.centres[near] - query) ** 2).sum(axis=1))
            computed += len(near)
            least = np.maximum(distances - node.radii[near], 0.0)
            for k, low, far in zip(near.tolist(), least.tolist(), distances.tolist()):
                if low <= reach:
                    tick += 1
                    heapq.heappush(queue, (low, tick, far, node.children[k]))
            continue
        # Entries stand in the order of their distance from the routing vector.
        a, b = np.searchsorted(node.apart, [d - reach, d + reach + _MARGIN])
        found = node.vectors[a:b] @ asked
        computed += int(b - a)
        keep = (found >= scores[-1] if len(scores) == count else np.ones(len(found), bool)) & (node.ids[a:b] != own)
        if keep.any():
            scores, names = np.concatenate([scores, found[keep]]), np.concatenate([names, node.ids[a:b][keep]])
            order = np.lexsort((names, -scores))[:count]
            scores, names = scores[order], names[order]
            if len(scores) == count:
                reach = float(np.sqrt(max(constant - 2 * float(scores[-1]), 0.0))) + _MARGIN
    return [(int(s), int(i)) for s, i in zip(scores, names)], computed


def _number(longest: int) -> type:
    """Sums of products below 2^24 or 2^53 are whole in floating point, which multiplies faster."""
    return np.float32 if longest < 2**23 else np.float64 if longest < 2**52 else np.int64


def _packed(page: Page) -> tuple:
    return (page.routing, page.radius, page.apart, [_packed(c) for c in page.children], page.centres, page.radii, page.vectors, page.ids)


def _unpacked(fields: tuple) -> Page:
    return Page(*fields[:3], [_unpacked(c) for c in fields[3]], *fields[4:])


def _plant(table: pa.Table, longest: int) -> pa.Table:
    """The trees of one shard, one for each size of vectors."""
    table = table.combine_chunks()
    ids, sizes, lengths = (table[c].to_numpy() for c in ("id", "n", "length"))
    flat = table["v"].combine_chunks().flatten().to_numpy() if table.num_rows else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        exact = flat[starts[mine][:, None] + np.arange(size)]
        points = np.concatenate([exact, np.sqrt(np.maximum(longest - lengths[mine], 0))[:, None]], axis=1).astype(float)
        out.append((size, pickle.dumps(_packed(build(points, exact.astype(_number(longest)), ids[mine])))))
    return pa.table([pa.array([n for n, _ in out], pa.int32()), pa.array([t for _, t in out], pa.binary())], names=["n", "tree"])


def _ask(trees: DataFrame, asked: pa.Table, longest: float, count: int) -> DataFrame:
    """The best of each tree for a block of queries."""
    asked = asked.combine_chunks()
    ids, sizes = asked["id"].to_numpy(), asked["n"].to_numpy()
    flat = asked["v"].combine_chunks().flatten().to_numpy() if asked.num_rows else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, tree in zip(batch["n"].to_pylist(), batch["tree"]):
                root, out = _unpacked(pickle.loads(tree.as_buffer())), []
                for q in np.flatnonzero(sizes == size).tolist():
                    vector = flat[starts[q] : starts[q] + size].astype(_number(int(longest)))
                    found, _ = search(root, longest, vector, int(ids[q]), count)
                    out += [(int(ids[q]), i, s) for s, i in found]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return trees.mapInArrow(answer, _FOUND)


def top_scores(
    vectors: DataFrame, id_name: str = "vec_id", vector_name: str = "embedding", every: int = 20,
    count: int = NEIGHBOURS, scale: int = SCALE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` of the `count` highest scores of each query.

    Components become floor(scale * x). Queries are the rows whose id is divisible
    by `every`; candidates are all rows but the query's own. Rows with a null id, a
    null vector or a component that is null or not finite take no part, nor do
    vectors whose size differs from the query's. Rows that repeat an id are
    candidates each, and query once each distinct vector.
    """
    whole = F.transform(vector_name, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    finite = F.forall(vector_name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_name).isNotNull() & F.col(vector_name).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_name).cast("long").alias("id"), whole.alias("v"), F.size(vector_name).alias("n")
    )
    squared = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    rows = written(rows.withColumn("length", squared), "vectors")
    total, longest = rows.agg(F.count(F.lit(1)), F.max("length")).first()
    shards = max(1, -(-total // shard_rows))
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    # Each row goes to its shard once, and each shard's trees are written once.
    shard = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(shards)).cast("int")
    trees = written(
        rows.withColumn("shard", shard).groupBy("shard").applyInArrow(lambda t: _plant(t, longest), "n int, tree binary"), "trees"
    )
    # Queries go to the trees in blocks of bounded size; only the best of each shard come back.
    widest = max(1, queries.agg(F.max("n")).first()[0] or 1)
    per_block = max(1, min(query_rows, QUERY_BYTES // (8 * widest)))
    blocks = max(1, -(-queries.count() // per_block))
    place = work_dir(vectors.sparkSession, "found")
    for k in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(blocks)) == k).select("id", "v", "n").toArrow()
        _ask(trees, asked, float(longest or 0), count).write.mode("append").parquet(place)
    found = vectors.sparkSession.read.schema(_FOUND).parquet(place)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select(
        "query_id", "rank", "vec_id", "score"
    )


ORACLE = """
WITH whole AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
