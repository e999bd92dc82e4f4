"""The documents that rank highest for each item by their terms, exactly.

Each task cuts its documents into shards and writes an inverted index of each:
per term the documents that hold it, in order, and how often. Terms that no item
asks for are left out by a bit table of fixed size. The index is written once;
counts over all documents come from its small columns.

Items go through the index in blocks of bounded size. In a shard an item's lists
are split by length. The short ones are added up term at a time: their documents
with the sums so far become one list, bounded by its sums like any other. That
list and the long ones are then walked document at a time, in windows of blocks of
neighbouring documents: a block whose bounds add up to less than the tenth best
score is skipped by all lists; among the rest, long lists that cannot lift a
document of their own into the best are only looked up for documents the others
found, while they still can be lifted. Best documents of shards meet by item.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import give_back, ragged, slices, words_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BEST = 10
ASKED_BITS = 23
SHARD_POSTINGS = 2_000_000
SHARD_BYTES = 64 << 20  # of text, where few terms are asked for
BLOCK_TERMS = 1 << 18  # of items that search together
NEIGHBOURS = 128  # documents of a block
WINDOW = 32  # blocks
SHORT = 16  # a list is short if it holds fewer than one in so many documents

_APART = np.ones(256, dtype=bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_INDEX = (
    "n_docs long, n_terms long, terms array<long>, held array<long>, "
    "ids array<long>, lengths binary, places binary, often binary"
)


def _terms(column: pa.Array):
    """Borders of rows among their terms, and a 64-bit hash of each term."""
    words = words_of(column, True, _APART)
    return words.first, words.hashes()


def item_terms(items: DataFrame) -> DataFrame:
    """`item`, `term` for each different term of `items` (`item`, `text`)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            first, hashes = _terms(part["text"])
            item = np.repeat(part["item"].to_numpy(), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(hashes.view(np.int64))], names=["item", "term"])

    return items.mapInArrow(spell, "item long, term long").distinct()


def _place(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - ASKED_BITS)).astype(np.int64)


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per shard of `docs` (`doc_id`, `text`), with lists of `terms` and of few others."""
    placed = F.shiftrightunsigned("term", 64 - ASKED_BITS)
    asked = np.zeros(1 << ASKED_BITS, dtype=bool)
    asked[terms.select(placed.alias("place")).distinct().toArrow()["place"].to_numpy()] = True
    bits = np.packbits(asked, bitorder="little")

    def shard(ids: list, lengths: list, places: list, found: list) -> pa.RecordBatch:
        length = np.concatenate(lengths)
        place, term = np.concatenate(places), np.concatenate(found)
        order = np.argsort(term, kind="stable")  # places stay in order
        place, term = place[order], term[order]
        opens = np.ones(len(term), dtype=bool)
        opens[1:] = (term[1:] != term[:-1]) | (place[1:] != place[:-1])
        begins = np.flatnonzero(opens)
        often = np.diff(np.append(begins, len(term)))
        place, term = place[begins], term[begins]
        heads = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        held = np.diff(np.append(heads, len(term)))
        one = [np.array([k]) for k in (len(heads), len(heads), len(length))]
        return pa.RecordBatch.from_arrays(
            [pa.array([int((length > 0).sum())]), pa.array([int(length.sum())]),
             ragged(term[heads].view(np.int64), one[0], pa.int64()), ragged(held, one[1], pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, len(length)], pa.int32()), pa.concat_arrays(ids)),
             *[pa.array([a.astype("<u4").tobytes()], pa.binary()) for a in (length, place, often)]],
            names=["n_docs", "n_terms", "terms", "held", "ids", "lengths", "places", "often"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, places, found = [], [], [], []
        documents = postings = size = 0
        for part in slices(batches, "text"):
            first, hashes = _terms(part["text"])
            length = np.diff(first)
            at = _place(hashes)
            asked_for = np.flatnonzero((bits[at >> 3] >> (at & 7)) & 1)
            ids.append(part["doc_id"])
            lengths.append(length)
            places.append(np.repeat(np.arange(documents, documents + len(length), dtype=np.uint32), length)[asked_for])
            found.append(hashes[asked_for])
            documents += len(length)
            postings += len(asked_for)
            size += part["text"].nbytes
            if postings >= SHARD_POSTINGS or size >= SHARD_BYTES:
                yield shard(ids, lengths, places, found)
                ids, lengths, places, found = [], [], [], []
                documents = postings = size = 0
        if documents:
            yield shard(ids, lengths, places, found)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, _INDEX)


class Shard:
    """Lists of a shard with the worth of each entry, before it is weighed by its term."""

    def __init__(self, row: dict, documents: int, occurrences: int) -> None:
        number = lambda name: np.frombuffer(row[name], "<u4").astype(np.int64)
        self.places, often = number("places"), number("often")
        length = number("lengths")
        m = 100 - 90 + 90 * length * documents // occurrences
        self.worth = 1_000_000_000 * often // (1000 * often + 8 * m[self.places])
        self.terms = row["terms"].view(np.uint64)
        self.ends = np.cumsum(row["held"])
        self.documents = len(length)
        self.blocks = -(-self.documents // NEIGHBOURS)
        self.bounds: dict[int, np.ndarray] = {}

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """Number of the list of each term; -1 where the shard has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def entries(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        low = self.ends[k - 1] if k else 0
        return self.places[low : self.ends[k]], self.worth[low : self.ends[k]]

    def block_bounds(self, places: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """Highest worth in each block of neighbours."""
        out = np.zeros(self.blocks, dtype=np.int64)
        if len(places):
            block = places // NEIGHBOURS
            begins = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            out[block[begins]] = np.maximum.reduceat(worth, begins)
        return out

    def bound_of(self, k: int) -> np.ndarray:
        if k not in self.bounds:
            self.bounds[k] = self.block_bounds(*self.entries(k))
        return self.bounds[k]


def accumulated(shard: Shard, short: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: documents of the short lists, in order, with their sums."""
    if not short:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = [(places, weight * worth) for weight, k in short for places, worth in [shard.entries(k)]]
    places, sums = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(places, kind="stable")
    places, sums = places[order], sums[order]
    begins = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    return places[begins], np.add.reduceat(sums, begins)


class Best:
    """The highest scores so far, equal ones by ascending id, none behind them."""

    def __init__(self, ids: np.ndarray, size: int) -> None:
        self.ids, self.size = ids, size  # ranks of ids, so that none sorts last
        self.places, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = 1  # a score must be above 0

    def offer(self, places: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.least
        places, scores = np.append(self.places, places[keep]), np.append(self.scores, scores[keep])
        order = np.lexsort((self.ids[places], -scores))[: self.size]
        self.places, self.scores = places[order], scores[order]
        if len(order) == self.size:
            self.least = max(self.least, int(self.scores[-1]))


def search_shard(shard: Shard, best: Best, lists: list[tuple[int, int]]) -> None:
    """Offer `best` every document of the shard that can be among the best for `lists` (weight, number)."""
    size = lambda k: int(shard.ends[k] - (shard.ends[k - 1] if k else 0))
    short = [x for x in lists if size(x[1]) * SHORT < shard.documents]
    long_ = [x for x in lists if size(x[1]) * SHORT >= shard.documents]
    places, sums = accumulated(shard, short)
    if not long_:
        best.offer(places, sums)
        return
    # Sums so far never exceed scores, so the best of them are a threshold from the start.
    if len(sums) >= best.size:
        best.least = max(best.least, int(np.partition(sums, -best.size)[-best.size]))
    long_bounds = [weight * shard.bound_of(k) for weight, k in long_]
    bounds = shard.block_bounds(places, sums) + sum(long_bounds)
    # Least first: of a front of them, no document of its own can reach the threshold.
    by_bound = sorted(range(len(long_)), key=lambda x: long_bounds[x].max())
    reach = np.cumsum([int(long_bounds[x].max()) for x in by_bound])
    at = 0
    while True:
        blocks = np.flatnonzero(bounds[at:] >= best.least)[:WINDOW] + at
        if not len(blocks):
            return
        at = int(blocks[-1]) + 1
        _window(shard, best, blocks, places, sums, [long_[x] for x in by_bound], reach)


def _window(shard, best, blocks, places, sums, long_, reach) -> None:
    """Score the documents of some blocks that can reach the threshold."""
    room = np.full(int(blocks[-1] - blocks[0]) + 1, -1)
    room[blocks - blocks[0]] = np.arange(len(blocks))
    base = int(blocks[0]) * NEIGHBOURS
    end = (int(blocks[-1]) + 1) * NEIGHBOURS
    scores = np.zeros(len(blocks) * NEIGHBOURS, dtype=np.int64)

    def cells(found: np.ndarray) -> np.ndarray:
        """Cells of documents; -1 in blocks that are skipped."""
        cell = room[(found - base) // NEIGHBOURS]
        return np.where(cell < 0, -1, cell * NEIGHBOURS + (found - base) % NEIGHBOURS)

    def add(found: np.ndarray, values: np.ndarray) -> None:
        low, high = np.searchsorted(found, [base, end])
        cell = cells(found[low:high])
        inside = cell >= 0
        scores[cell[inside]] += values[low:high][inside]

    lookups = int(np.searchsorted(reach, best.least))  # lists that can't lift a document by themselves
    add(places, sums)
    for weight, k in long_[lookups:]:
        found, worth = shard.entries(k)
        low, high = np.searchsorted(found, [base, end])
        add(found[low:high], weight * worth[low:high])
    alive = np.flatnonzero(scores)
    for x in range(lookups - 1, -1, -1):
        alive = alive[scores[alive] + reach[x] >= best.least]
        if not len(alive):
            return
        weight, k = long_[x]
        found, worth = shard.entries(k)
        wanted = blocks[alive // NEIGHBOURS] * NEIGHBOURS + alive % NEIGHBOURS
        spot = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
        scores[alive] += np.where(found[spot] == wanted, weight * worth[spot], 0)
    best.offer(blocks[alive // NEIGHBOURS] * NEIGHBOURS + alive % NEIGHBOURS, scores[alive])


def search_block(index: DataFrame, asked: pa.Table, documents: int, occurrences: int, best: int) -> DataFrame:
    """`item`, `doc_id`, `score` of the best documents of each shard for a block of items."""
    item, term, weight = (asked[c].to_numpy() for c in ("item", "term", "weight"))
    order = np.argsort(item, kind="stable")
    item, term, weight = item[order], term[order].view(np.uint64), weight[order]
    begins = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)]).tolist()
    borders = list(zip(begins, [*begins[1:], len(item)]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                cell = lambda name: batch[name][at]  # noqa: E731, B023
                row = {c: cell(c).values.to_numpy() for c in ("terms", "held")}
                row |= {c: cell(c).as_buffer() for c in ("lengths", "places", "often")}
                ids = cell("ids").values
                shard = Shard(row, documents, occurrences)
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                rank = np.empty(len(ids), dtype=np.int64)
                rank[np.lexsort((ids.fill_null(0).to_numpy(), missing))] = np.arange(len(ids))
                numbers = shard.lists(term)
                out = []
                for low, high in borders:
                    lists = [(int(weight[k]), int(numbers[k])) for k in range(low, high) if numbers[k] >= 0]
                    if lists:
                        top = Best(rank, best)
                        search_shard(shard, top, lists)
                        out.append((np.full(len(top.places), item[low]), top.places, top.scores))
                if out:
                    items, places, scores = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(items), ids.take(pa.array(places)), pa.array(scores)], names=["item", "doc_id", "score"]
                    )
        give_back()

    return index.select("terms", "held", "ids", "lengths", "places", "often").mapInArrow(search, "item long, doc_id long, score long")


def top_documents(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """`item_id`, `rank`, `doc_id`, `score`: the `best` documents with a score above 0 for each item.

    Equal scores rank by ascending doc_id. A document without an id counts and ranks
    behind others of its score, with a null id; rows that repeat an id are documents of
    their own. Null and empty texts have no terms; an item without terms, or whose terms
    no document holds, has no rows. Items that repeat id and text are one; an id with
    several texts, or none, has ranks for each text. Other columns are not read. Terms
    are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    named = written(items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
                    .withColumn("item", F.monotonically_increasing_id()), "items")
    terms = written(item_terms(named.select("item", "text")), "item-terms")
    index = written(build_index(docs, terms), "lists")
    counts = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    held = index.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(
        F.sum("x.held").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.lit(counts.n) + 2) / (2 * F.col("df") + 1)))
    weighed = written(terms.join(held, "term").select("item", "term", weight.alias("weight")).where("weight > 0"), "weights")
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    blocks = max(1, -(-weighed.count() // BLOCK_TERMS))
    for k in range(blocks if counts.l else 0):
        asked = weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toArrow()
        if asked.num_rows:
            found = found.unionByName(search_block(index, asked, counts.n, counts.l, best))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH listed AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM listed GROUP BY doc_id),
sums AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
entries AS (SELECT doc_id, term, count(*) AS tf FROM listed WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM entries, sums GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM entries JOIN lengths USING (doc_id) JOIN weights USING (term) JOIN asked USING (term), sums GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
