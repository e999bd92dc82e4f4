"""Words that long passages of smaller documents repeat, by FM-indexes over shards.

A window is a fixed number of consecutive words. The least hash of the short word
runs inside a window is its anchor: equal windows have equal anchors, and one
anchor serves a run of neighbouring windows. Runs of equal words stand for one
another, owned by the smallest document that holds them; anchors of one document
alone are dropped, and the others bring their different runs together in shards.

A shard's index is the Burrows-Wheeler transform of its runs, word by word, in a
wavelet matrix of packed bits; suffixes are in order as far as windows reach. Each
run is streamed against the index from its last word to its first: backward search
keeps the suffixes that begin with the longest match so far, cut off at a window's
length, and where a match cannot be extended, or is that long, its last words are
given up by the common prefixes of neighbouring suffixes. These are the run's
matching statistics. Where a match of a window's length has a smaller owner among
its suffixes, the window is reported; neighbouring ones make an interval.

All other copies of a run are covered as a whole, since its owner is smaller. An
anchor of more than CROWDED different runs would fill a shard; its windows are
streamed one by one, to the shards of their own hashes, equal ones once.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import Words, asked_rows, grams, mix, slices, words_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 50
ANCHOR = 10
LONGEST_RUN = 64
CROWDED = 16_384
SHARD_WINDOWS = 150_000
WORD_BYTES = 6  # of a word's hash

_RUNS = "anchor long, run_key long, count int, doc_id long, text_key long, begin int"
_RUN = ["anchor", "run_key", "count"]
_PIECES = (
    "anchor long, run_key long, count int, route long, owner long, place int, size int, crowded boolean, words binary"
)
_COVERED = "anchor long, run_key long, count int, low int, high int"


class WaveletMatrix:
    """Occurrences of a symbol in front of a position, over packed bits, one row of bits per binary digit."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.size, self.digits = len(symbols), digits
        self.words, self.sums, self.zeros = [], [], []
        for digit in range(digits - 1, -1, -1):
            bits = (symbols >> digit) & 1 == 1
            packed = np.packbits(np.append(bits, np.zeros(128 - len(bits) % 64, bool)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]))
            self.zeros.append(int(self.size - bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def moved(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions `at` end up, each among the rows of its symbol."""
        for row, digit in enumerate(range(self.digits - 1, -1, -1)):
            ones = self.sums[row][at >> 6] + np.bitwise_count(
                self.words[row][at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            )
            at = np.where((symbols >> digit) & 1 == 1, self.zeros[row] + ones, at - ones)
        return at


class FmIndex:
    """Backward search over a text of non-negative symbols; 0 separates and is in no pattern."""

    def __init__(self, text: np.ndarray, symbols: int, longest: int):
        """Suffixes are sorted by their first `longest` symbols, which is all that patterns up to there need."""
        size = len(text)
        rank, step, ranks = text.astype(np.int64), 1, []
        while True:
            ranks.append((step, rank.astype(np.int32)))
            behind = np.full(size, -1, dtype=np.int64)
            behind[:-step] = rank[step:]
            keys = rank * (max(size, symbols) + 2) + behind + 1
            self.places = np.argsort(keys, kind="stable")
            ordered = keys[self.places]
            changes = np.concatenate([[0], ordered[1:] != ordered[:-1]])
            rank = np.empty(size, dtype=np.int64)
            rank[self.places] = np.cumsum(changes)
            step *= 2
            if step >= longest or step >= size:
                break
        # What each suffix has in common with the one in front of it in order, up to twice the last step.
        self.common = np.zeros(size + 1, dtype=np.int64)
        one, other, common = self.places[:-1], self.places[1:], np.zeros(max(size - 1, 0), dtype=np.int64)
        for step, rank in reversed(ranks):
            a, b = one + common, other + common
            same = (a < size) & (b < size)
            same[same] = rank[a[same]] == rank[b[same]]
            common[same] += step
        self.common[1:size] = common
        self.common[0] = self.common[size] = -1
        self._cuts: dict[int, np.ndarray] = {}
        digits = max(int(symbols).bit_length(), 1)
        self.tree = WaveletMatrix(text[self.places - 1].astype(np.int64), digits)
        counts = np.bincount(text, minlength=symbols + 1)
        self.begins = np.concatenate([[0], np.cumsum(counts)])
        every = np.arange(symbols + 1)
        self.origin = self.tree.moved(every, np.zeros(symbols + 1, dtype=np.int64))

    def extended(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffixes begin with a symbol and then what the suffixes of given rows begin with."""
        both = self.tree.moved(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.begins[symbols] - self.origin[symbols]
        return base + both[: len(low)], base + both[len(low) :]

    def shortened(self, length: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffixes share their first `length` symbols with those of given rows, which share more."""
        if length not in self._cuts:
            self._cuts[length] = np.flatnonzero(self.common < length)
        cuts = self._cuts[length]
        return cuts[np.searchsorted(cuts, low, side="right") - 1], cuts[np.searchsorted(cuts, high)]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array that begin with each pattern (one per row of `patterns`): from, to."""
        last = patterns[:, -1]
        low, high = self.begins[last], self.begins[last + 1]
        for symbols in patterns[:, -2::-1].T:
            low, high = self.extended(symbols, low, high)
        return low, high

    def statistics(self, stream: np.ndarray, ends: np.ndarray, sizes: np.ndarray, most: int):
        """Matching statistics of streams, cut off at `most`: from each place on, how long the match is and its rows.

        Stream i is `stream[ends[i] - sizes[i] : ends[i]]`; a symbol the text lacks is
        negative and in no match. All streams go from their ends to their beginnings
        side by side.
        """
        lengths = np.zeros(len(stream), dtype=np.int64)
        lows, highs = np.zeros_like(lengths), np.zeros_like(lengths)
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = ends[order], sizes[order]
        length = np.zeros(len(ends), dtype=np.int64)
        low, high = np.zeros_like(length), np.full(len(ends), len(self.places), dtype=np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step))  # streams that are longer than `step`
            length, low, high = length[:live], low[:live], high[:live]
            at = ends[:live] - 1 - step
            symbols = stream[at]
            full = length == most
            if full.any():
                low[full], high[full] = self.shortened(most - 1, low[full], high[full])
                length[full] -= 1
            todo = np.flatnonzero(symbols > 0)
            length[symbols <= 0], low[symbols <= 0], high[symbols <= 0] = 0, 0, len(self.places)
            while len(todo):
                a, b = self.extended(symbols[todo], low[todo], high[todo])
                found = a < b
                done = todo[found]
                low[done], high[done] = a[found], b[found]
                length[done] += 1
                todo = todo[~found]
                # What cannot be extended gives up its last symbols, as many as the next shorter match asks for.
                todo = todo[length[todo] > 0]
                if len(todo):
                    inner = np.maximum(self.common[low[todo]], self.common[high[todo]])
                    for size in np.unique(np.minimum(inner, length[todo] - 1)).tolist():
                        mine = todo[np.minimum(inner, length[todo] - 1) == size]
                        if size <= 0:
                            length[mine], low[mine], high[mine] = 0, 0, len(self.places)
                        else:
                            low[mine], high[mine] = self.shortened(size, low[mine], high[mine])
                            length[mine] = size
            lengths[at], lows[at], highs[at] = length, low, high
        return lengths, lows, highs


def least_owners(words: np.ndarray, counts: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
    """Least owner of each window of a shard.

    Run i has `counts[i]` windows, and hashes of `counts[i] + window - 1` words in
    `words`; runs stand one behind the other.
    """
    sizes = counts + window - 1
    run = np.repeat(np.arange(len(counts)), sizes)
    distinct, symbols = np.unique(words, return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    # A separator behind each run, and one more at the end.
    at = np.arange(len(words)) + run
    text = np.zeros(len(words) + len(counts) + 1, dtype=np.int64)
    text[at] = symbols
    index = FmIndex(text, len(distinct), window)
    owner = np.full(len(text) + 1, np.iinfo(np.int64).max)
    owner[at] = owners[run]
    owner = np.append(owner[index.places], np.iinfo(np.int64).max)
    lengths, lows, highs = index.statistics(symbols, np.cumsum(sizes), sizes, window)
    starts = np.flatnonzero(lengths == window)
    # Rows of matches of one length are the same or apart.
    low, back = np.unique(lows[starts], return_inverse=True)
    high = np.zeros(len(low), dtype=np.int64)
    high[back] = highs[starts]
    if not len(low):
        return low
    return np.minimum.reduceat(owner, np.stack([low, high], axis=1).ravel())[::2][back]


def _run_keys(hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the words of each run: a polynomial of their hashes, from running sums."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
    powers, inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), x)]), dtype=np.uint64) for x in (odd, back))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes.copy()) * powers[:-1], dtype=np.uint64)])
    return mix((sums[first + sizes] - sums[first]) * inverse[first] + sizes.astype(np.uint64))


def _anchors(words: Words, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: first word, number of windows, anchor, key of the words, row."""
    room, hashes = words.room(), words.hashes()
    least = grams(hashes, size)
    width, have = window - size + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least, np.concatenate([least[step:], least[-step:]])[: len(least)]) if len(least) else least
        have += step
    starts = np.flatnonzero(room >= window)
    if not len(starts):
        return starts, starts, least[:0], least[:0], starts
    anchor = least[starts]
    opens = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    head = np.flatnonzero(opens)
    place = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
    head = np.flatnonzero(opens | (place % LONGEST_RUN == 0))
    first = starts[head]
    rows = np.searchsorted(words.first, first, side="right") - 1
    counts = np.diff(np.append(head, len(starts)))
    return first, counts, anchor[head], _run_keys(hashes, first, counts + window - 1), rows


def _digest(words: Words, keep: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Kept words of each row: how many, and sha256 of them joined by a space."""
    data = words.data.copy()
    bounds = words.first
    kept = np.flatnonzero(keep)
    rows = np.searchsorted(bounds, kept, side="right") - 1
    counts = np.bincount(rows, minlength=len(bounds) - 1)
    ends = words.ends[kept].copy()
    final = np.concatenate([rows[1:] != rows[:-1], [True]]) if len(kept) else np.zeros(0, bool)
    # A kept word that another follows takes the white space behind it along, as a space.
    data[ends[~final]] = 0x20
    ends[~final] += 1
    sizes = ends - words.starts[kept]
    last = np.bincount(rows, sizes, minlength=len(bounds) - 1).astype(np.int64)
    mark = np.zeros(len(data) + 1, dtype=np.int8)
    mark[words.starts[kept]] += 1
    np.subtract.at(mark, ends, 1)
    joined = data[np.cumsum(mark[:-1], dtype=np.int8) > 0].tobytes()
    stops = np.cumsum(last).tolist()
    return counts, [hashlib.sha256(joined[a:b]).hexdigest() for a, b in zip([0, *stops], stops)]


def _stored(hashes: np.ndarray) -> np.ndarray:
    """The upper bytes of word hashes, a row each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES :])


def _loaded(column: pa.ChunkedArray) -> np.ndarray:
    """Word hashes of all cells, one behind the other."""
    raw = np.frombuffer(b"".join(cell.as_buffer() for cell in column), np.uint8).reshape(-1, WORD_BYTES)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, 8 - WORD_BYTES :] = raw
    return out.view("<u8").ravel()


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """`doc_id`, `text_key`, `begin`, `end` (words) of runs of repeated windows; spans may overlap.

    `docs` has `doc_id`, `text` and `text_key`, a hash of the text, which keeps
    texts of one id apart. Rows without an id take no part. `window` must be at least
    `anchor`.
    """
    spark = docs.sparkSession

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part["text"])
            first, counts, anchors, keys, rows = _anchors(words, window, anchor)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.view(np.int64)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int32)),
                 part["doc_id"].take(take), part["text_key"].take(take), pa.array((first - words.first[rows]).astype(np.int32))],
                names=["anchor", "run_key", "count", "doc_id", "text_key", "begin"],
            )

    named = docs.where("doc_id is not null").select("doc_id", "text", "text_key")
    found = written(named.mapInArrow(runs, _RUNS), "runs")
    # Each different run with the smallest document that holds it; one place there stands for all.
    first_place = F.min(F.struct("doc_id", "text_key", "begin")).alias("first")
    different = found.groupBy(*_RUN).agg(first_place, F.max("doc_id").alias("high"))
    met = different.groupBy("anchor").agg(
        F.min("first.doc_id").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n")
    ).where("low < high").select("anchor", (F.col("n") > CROWDED).alias("crowded"), (F.col("n") == 1).alias("alone"))
    shared = written(different.select(*_RUN, "first").join(met, "anchor"), "shared-runs")
    # A run that nothing else shares its anchor with has equal copies only, which its owner decides.
    streamed = shared.where("not alone")
    per_text = streamed.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).agg(
        F.collect_list(F.struct(F.col("first.begin").alias("begin"), *_RUN, "crowded")).alias("runs")
    )
    texts = asked_rows(named, streamed.select(F.col("first.doc_id").alias("doc_id")), "doc_id").dropDuplicates(["doc_id", "text_key"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs with their words; of crowded anchors a row for each window."""
        for part in slices(batches, "text"):
            words = words_of(part["text"])
            hashes = words.hashes()
            stored = _stored(hashes)
            sizes, flat = part["runs"].value_lengths().to_numpy(), part["runs"].flatten()
            row = np.repeat(np.arange(part.num_rows), sizes)
            begin, count = (flat.field(c).to_numpy().astype(np.int64) for c in ("begin", "count"))
            anchors, crowded = flat.field("anchor").to_numpy(), flat.field("crowded").to_numpy(zero_copy_only=False)
            split = np.where(crowded, count, 1)
            of = np.repeat(np.arange(len(row)), split)
            place = np.arange(len(of)) - np.repeat(np.cumsum(split) - split, split)
            size = np.where(crowded[of], 1, count[of])
            at = words.first[row[of]] + begin[of] + place
            own = _run_keys(hashes, at, size + window - 1).view(np.int64)
            data = [stored[a : a + n + window - 1].tobytes() for a, n in zip(at.tolist(), size.tolist())]
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [*[flat.field(c).take(take) for c in _RUN], pa.array(np.where(crowded[of], own, anchors[of])),
                 part["doc_id"].take(pa.array(row[of])), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)),
                 pa.array(crowded[of]), pa.array(data, pa.binary())],
                names=[*_RUN, "route", "owner", "place", "size", "crowded", "words"],
            )

    pieces = written(texts.join(per_text, ["doc_id", "text_key"]).mapInArrow(emit, _PIECES), "run-words")
    windows = pieces.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-windows // SHARD_WINDOWS))
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int").alias("shard")

    def least_of(table: pa.Table) -> np.ndarray:
        return least_owners(_loaded(table["words"]), table["size"].to_numpy().astype(np.int64), table["owner"].to_numpy(), window)

    def cover(table: pa.Table) -> pa.Table:
        """Intervals of windows, within their runs, that a smaller document holds."""
        table = table.combine_chunks()
        counts = table["size"].to_numpy().astype(np.int64)
        run = np.repeat(np.arange(len(counts)), counts)
        covered = least_of(table) < table["owner"].to_numpy()[run]
        inner = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        a = np.flatnonzero(covered & ((inner == 0) | ~np.concatenate([[False], covered[:-1]])))
        b = np.flatnonzero(covered & ((inner == counts[run] - 1) | ~np.concatenate([covered[1:], [False]])))
        return pa.table(
            [*[table[c].take(pa.array(run[a])) for c in _RUN], pa.array(inner[a].astype(np.int32)), pa.array((inner[b] + 1).astype(np.int32))],
            names=[*_RUN, "low", "high"],
        )

    def least_owner(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return pa.table([table["route"], table["words"], pa.array(least_of(table))], names=["route", "words", "least"])

    intervals = pieces.where("not crowded").select(shard, *_RUN, "owner", "size", "words").groupBy("shard").applyInArrow(cover, _COVERED)
    single = pieces.where("crowded")
    combined = single.groupBy("route", "words").agg(F.min("owner").alias("owner")).withColumn("size", F.lit(1))
    answers = combined.select(shard, "route", "words", "owner", "size").groupBy("shard").applyInArrow(
        least_owner, "route long, words binary, least long"
    )
    more = single.join(answers, ["route", "words"]).where("least < owner").select(
        *_RUN, F.col("place").alias("low"), (F.col("place") + 1).alias("high")
    )
    held = found.join(shared.select(*_RUN, F.col("first.doc_id").alias("owner")), _RUN)
    copies = held.where("doc_id > owner").select("doc_id", "text_key", "begin", (F.col("begin") + F.col("count") + window - 1).alias("end"))
    own = held.where("doc_id = owner").join(intervals.unionByName(more), _RUN).select(
        "doc_id", "text_key", (F.col("begin") + F.col("low")).alias("begin"), (F.col("begin") + F.col("high") + window - 1).alias("end")
    )
    return copies.unionByName(own)


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """`doc_id`, `n_words`, `n_removed`, `kept_sha256` of each row.

    Words covered by a window that also begins in a document of a smaller id are
    removed; windows are judged on the input. A null text has no words. Rows
    without an id neither lose words nor cost others theirs. Rows of one id don't
    count against each other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "text_key", F.xxhash64("text")
    )
    spans = written(repeated_spans(rows, window, anchor), "spans")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part["text"])
            counts, sums = _digest(words, np.ones(len(words.starts), dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_key"], pa.array(counts), pa.array(sums)],
                names=["doc_id", "text_key", "n_words", "sha256"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part["text"])
            lists = part["spans"]
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            deep = np.zeros(len(words.starts) + 1, dtype=np.int64)
            np.add.at(deep, words.first[row] + flat.field("begin").to_numpy(), 1)
            np.subtract.at(deep, words.first[row] + flat.field("end").to_numpy(), 1)
            keep = np.cumsum(deep[:-1]) == 0
            counts, sums = _digest(words, keep)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_key"], pa.array(np.diff(words.first) - counts), pa.array(sums)],
                names=["doc_id", "text_key", "n_removed", "cut_sha256"],
            )

    whole = rows.mapInArrow(plain, "doc_id long, text_key long, n_words long, sha256 string")
    per_text = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    texts = asked_rows(rows.where("doc_id is not null"), spans.select("doc_id"), "doc_id").dropDuplicates(["doc_id", "text_key"])
    removed = written(
        texts.join(per_text, ["doc_id", "text_key"]).mapInArrow(
            cut, "doc_id long, text_key long, n_removed long, cut_sha256 string"
        ), "cut",
    )
    return whole.join(removed, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
    )


ORACLE = r"""
WITH listed AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM listed WHERE len(w) >= 50)),
owners AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN owners USING (h) WHERE first < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1)::BIGINT AS p FROM listed),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT l.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k ON k.doc_id = l.doc_id
"""
