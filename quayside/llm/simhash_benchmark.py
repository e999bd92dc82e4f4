"""Benchmark passages in documents, by SimHash of windows as long as an item.

Similarity of a window and an item is that of their weighted shingles: the sum of
the smaller counts over the sum of the larger ones. A window is looked at if it
holds enough shingles that items of its length have (a bit table of fixed size
tells; it may say yes for others, never no), which no similar window can lack.
Such windows get a 64-bit SimHash, weighted by counts. Fingerprints within
`RADIUS` bits of an item's agree with it in one of `BLOCKS` blocks up to
`RADIUS // BLOCKS` bits: items stand under all such values of each block, so an
equi-join finds every item within the radius. The exact similarity decides: texts with
such windows are read again, and their windows slide along the item one word at a time.
A document shorter than an item is one window as a whole, under the item's length.

At similarity 0.75 a fingerprint bit differs with probability 0.17: 11 of 64 on
average. The radius of 24 lies four standard deviations above.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import asked_rows, grams, mix, slices, words_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
PERCENT = 75
RADIUS = 24
BLOCKS = 8
TABLE_BITS = 22

SPAN = 1 << 16  # neighbouring windows that get their fingerprints together

_WINDOWS = "doc_id long, text_key long, begin int, n_words int, held int, fingerprint long"


def _shingles(hashes: np.ndarray, words: int, size: int) -> np.ndarray:
    """Shingles from each word on, for windows of `words` words; short ones are one shingle as a whole."""
    return grams(hashes, min(size, words))


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingles: a bit is set where more of them have it than not."""
    votes = np.zeros((len(shingles), 64), dtype=np.int32)
    for column in shingles.T:
        bits = np.unpackbits(mix(column).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits
    return np.packbits(2 * votes > shingles.shape[1], axis=1, bitorder="little").view("<u8").ravel().view(np.int64)


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, per: int) -> np.ndarray:
    """As `fingerprints` of the `per` shingles from each of the sorted `starts` on, by running sums of votes."""
    out = np.zeros(len(starts), dtype=np.int64)
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + SPAN))
        low, high = int(starts[at]), int(starts[end - 1]) + per
        bits = np.unpackbits(mix(shingles[low:high]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((high - low + 1, 64), dtype=np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        votes = sums[starts[at:end] - low + per] - sums[starts[at:end] - low]
        out[at:end] = np.packbits(2 * votes > per, axis=1, bitorder="little").view("<u8").ravel().view(np.int64)
        at = end
    return out


def _slots(shingles: np.ndarray, words: int) -> np.ndarray:
    return mix(shingles + np.uint64(words * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - TABLE_BITS)


def item_windows(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """`item_id`, `n_words`, `fingerprint` and `shingles` of each item; items without words make none."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part["text"], True)
            hashes, bounds = words.hashes(), words.first.tolist()
            kept = [(k, hashes[a:b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
            sets = [_shingles(h, len(h), size)[: max(len(h) - size + 1, 1)] for _, h in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    part["item_id"].take(pa.array([k for k, _ in kept], pa.int64())),
                    pa.array([len(h) for _, h in kept], pa.int32()),
                    pa.array([int(fingerprints(s[None, :])[0]) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["item_id", "n_words", "fingerprint", "shingles"],
            )

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(describe, "item_id long, n_words int, fingerprint long, shingles array<long>")


def _tables(items: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bit tables of shingles, of shingles with their item's length, and the lengths.

    Executors send table positions, each once: 2^22 at most, whatever the items.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, shingles in zip(batch["n_words"].to_pylist(), batch["shingles"]):
                s = np.array(shingles.values.to_numpy()).view(np.uint64)
                both = [np.unique(_slots(s, 0)), np.unique(_slots(s, words))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [len(b) for b in both]).astype(np.int32)),
                     pa.array(np.concatenate(both).astype(np.int64))],
                    names=["kind", "slot"],
                )

    got = items.mapInArrow(place, "kind int, slot long").distinct().toArrow()
    tables = np.zeros((2, 1 << TABLE_BITS), dtype=bool)
    if got.num_rows:
        tables[got["kind"].to_numpy(), got["slot"].to_numpy()] = True
    lengths = sorted(r[0] for r in items.select("n_words").distinct().collect())
    return tables[0], tables[1], lengths


def document_windows(
    docs: DataFrame, items: DataFrame, size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Windows of `docs` (`doc_id`, `text`, `text_key`) that may be similar to an item of their length.

    `held` is the number of a window's shingles. Documents shorter than an item, with
    enough shingles for it, are windows of the item's `n_words`.
    """
    any_length, by_length, lengths = _tables(items)
    any_length, by_length = np.packbits(any_length), np.packbits(by_length)

    def holds(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return (table[slots >> np.uint64(3)] >> (7 - (slots & np.uint64(7)).astype(np.uint8))) & 1 == 1

    def windows(part, words, shingles: np.ndarray, starts: np.ndarray, per: int, n: int) -> pa.RecordBatch:
        """Windows of `per` shingles each for items of `n` words."""
        rows = np.searchsorted(words.first, starts, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [
                *[part[c].take(pa.array(rows)) for c in ("doc_id", "text_key")],
                pa.array((starts - words.first[rows]).astype(np.int32)),
                *[pa.array(np.full(len(starts), v, dtype=np.int32)) for v in (n, per)],
                pa.array(window_fingerprints(shingles, starts, per)),
            ],
            names=["doc_id", "text_key", "begin", "n_words", "held", "fingerprint"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part["text"], True)
            hashes, room = words.hashes(), words.room()
            counts = np.diff(words.first)
            for k in sorted({min(size, n) for n in lengths}):
                shingles = grams(hashes, k)
                whole = room >= k
                hit = np.flatnonzero(holds(any_length, _slots(shingles, 0)) & whole)
                if not len(hit):
                    continue
                for n in (n for n in lengths if min(size, n) == k):
                    mine = hit[holds(by_length, _slots(shingles[hit], n))]
                    per = n - k + 1  # shingles of a window
                    need = -(-2 * percent * per // (100 + percent))
                    own = counts - k + 1  # shingles of a whole document
                    least = -(-percent * (own + per) // (100 + percent))
                    short = np.flatnonzero((counts < n) & (own >= np.maximum(least, 1)))
                    begins = words.first[short]
                    held = np.searchsorted(mine, begins + own[short]) - np.searchsorted(mine, begins)
                    short = short[held >= least[short]]
                    for size_ in np.unique(own[short]).tolist():
                        yield windows(part, words, shingles, words.first[short[own[short] == size_]], size_, n)
                    # At a similar window's first hit, it has begun at most per - need places in front.
                    if len(mine) < need:
                        continue
                    starts = _in_front(mine, per - need, len(hashes))
                    starts = starts[room[starts] >= n]
                    held = np.searchsorted(mine, starts + per) - np.searchsorted(mine, starts)
                    starts = starts[held >= need]
                    if not len(starts):
                        continue
                    yield windows(part, words, shingles, starts, per, n)

    return docs.select("doc_id", "text", "text_key").mapInArrow(find, _WINDOWS)


def _in_front(places: np.ndarray, reach: int, size: int) -> np.ndarray:
    """Places, in order, that one of `places` is at most `reach` behind."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, np.maximum(places - reach, 0), 1)
    np.add.at(steps, places + 1, -1)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def overlaps(codes: list[int], counts: list[int], begins: list[int], per: int) -> list[int]:
    """Shingles in common, each as often as both have it, of windows that begin at sorted `begins` with an item.

    `codes` has the item's number of each shingle, -1 for others, and `counts` how often
    the item has each. A window follows from the one in front by what leaves and enters.
    """
    out, held, both, at = [], [0] * len(counts), 0, None
    for begin in begins:
        if at is None or begin - at >= per:
            held, both, leaving, entering = [0] * len(counts), 0, [], codes[begin : begin + per]
        else:
            leaving, entering = codes[at:begin], codes[at + per : begin + per]
        for code in leaving:
            if code >= 0:
                both -= held[code] <= counts[code]
                held[code] -= 1
        for code in entering:
            if code >= 0:
                both += held[code] < counts[code]
                held[code] += 1
        at = begin
        out.append(both)
    return out


def _block(number: int):
    width = 64 // BLOCKS
    return F.shiftrightunsigned("fingerprint", number * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _near_values() -> list[int]:
    """Patterns of at most RADIUS // BLOCKS bits of a block."""
    width = 64 // BLOCKS
    return [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in itertools.combinations(range(width), n)]


def contaminated(
    docs: DataFrame, items: DataFrame, size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """`doc_id`, `item_id`, `begin` (word), `n_words`, `similarity`: the best window of each document and item.

    Of equally similar windows the first counts. A null or empty text matches
    nothing, nor does an item without words; a document shorter than the item is
    compared as a whole. Items shorter than a shingle must
    occur as they are. Rows without an id are not reported. Repeated rows report once.
    Items without an id count too, each text by itself, and are reported with a null.
    """
    # Ids are payload; a key that is never null, of id and shingles, brings items back.
    keyed = item_windows(items, size).withColumn("item_key", F.xxhash64("item_id", "n_words", "shingles"))
    items = written(keyed, "items")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    found = written(document_windows(rows, items, size, percent), "windows")
    blocks = [F.struct(F.lit(b).alias("block"), _block(b).alias("value")) for b in range(BLOCKS)]
    near = F.array(*[F.lit(v) for v in _near_values()])
    asked = found.select("*", F.inline(F.array(*blocks)))
    offered = items.select("*", F.inline(F.array(*blocks))).withColumn(
        "value", F.explode(F.transform(near, lambda v: v.bitwiseXOR(F.col("value"))))
    )
    window = ["doc_id", "text_key", "n_words", "held"]
    pairs = (
        asked.select(*window, "begin", "fingerprint", "block", "value")
        .join(offered.select("item_key", "n_words", "block", "value", F.col("fingerprint").alias("theirs")),
              ["n_words", "block", "value"])
        .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("theirs"))) <= RADIUS)
        # One row per text and item, with the places its windows begin at.
        .groupBy(*window, "item_key").agg(F.sort_array(F.collect_set("begin")).alias("begins"))
    )
    pairs = written(pairs, "near-windows")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, out = words_of(part["text"], True), []
            hashes, bounds = words.hashes(), words.first.tolist()
            listed = zip(part["n_words"].to_pylist(), part["held"].to_pylist(), part["begins"], part["shingles"])
            for k, (n, per, begins, theirs) in enumerate(listed):
                mine = _shingles(hashes[bounds[k] : bounds[k + 1]], n, size)
                theirs, counts = np.unique(theirs.values.to_numpy().view(np.uint64), return_counts=True)
                code = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                code = np.where(theirs[code] == mine, code, -1)
                begins = begins.values.to_pylist()
                both = np.array(overlaps(code.tolist(), counts.tolist(), begins, per))
                similarity = both / (per + counts.sum() - both)
                # Of one document and item the best window counts, of equal ones the first.
                best = int(similarity.argmax())
                if 100 * similarity[best] >= percent:
                    out.append((k, begins[best], per + min(size, n) - 1, similarity[best]))
            at, begin, taken, similarity = list(zip(*out)) or [(), (), (), ()]
            named = [part[c].take(pa.array(at, pa.int64())) for c in ("doc_id", "item_id", "item_key")]
            yield pa.RecordBatch.from_arrays(
                [*named, pa.array(begin, pa.int32()), pa.array(taken, pa.int32()), pa.array(similarity, pa.float64())],
                names=["doc_id", "item_id", "item_key", "begin", "n_words", "similarity"],
            )

    # Only texts with such windows are read again and shuffled.
    texts = asked_rows(rows, pairs.select("doc_id"), "doc_id").dropDuplicates(["doc_id", "text_key"])
    met = pairs.join(texts, ["doc_id", "text_key"]).join(
        items.select("item_key", "n_words", "item_id", "shingles").dropDuplicates(["item_key", "n_words"]), ["item_key", "n_words"]
    )
    similar = met.select("doc_id", "text", "n_words", "held", "begins", "item_id", "item_key", "shingles").mapInArrow(
        verify, "doc_id long, item_id long, item_key long, begin int, n_words int, similarity double"
    )
    best = F.max(F.struct("similarity", (-F.col("begin")).alias("begin"), "n_words")).alias("best")
    unnamed = F.when(F.col("item_id").isNull(), F.col("item_key"))
    return similar.groupBy("doc_id", "item_id", unnamed.alias("_unnamed")).agg(best).select(
        "doc_id", "item_id", (-F.col("best.begin")).alias("begin"), "best.n_words", "best.similarity"
    )


def decontaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of `docs` without a window similar to an item, with their own columns."""
    found = contaminated(docs, items, size, percent).select("doc_id").distinct()
    kept = docs.join(written(found, "found"), "doc_id", "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
