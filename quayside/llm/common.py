"""What the operators of this folder share: words and their hashes in numpy, tables, seeds.

Texts reach Python tasks in Arrow batches. A batch is cut into slices of a few
megabytes, and a slice is handled as one byte array: word borders come from a
table over byte values and word hashes from eight bytes at a time, so no Python
object is made per word. Words are runs of `[^\\x20\\x09-\\x0D]`; a null text has
none.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import tune_texts, work_dir

# Tasks get the helpers below by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 2 << 20
BATCH_BYTES = 6 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def tuned(spark: SparkSession) -> SparkSession:
    """The library's settings, and batches of texts that leave memory to the tasks' own arrays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return tune_texts(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder, and read again with its own schema.

    What follows neither computes it again nor depends on the executors that did.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of a slice: where they are in `data`, and the first word of each row."""

    data: np.ndarray  # bytes, seven zeros behind them
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one entry more than rows

    @property
    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word, from all its bytes."""
        eight = np.ndarray((max(len(self.data) - 7, 0),), "<u8", self.data, 0, (1,))
        left = self.ends - self.starts
        out = mix(left.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        if not len(out):
            return out
        out = mix(out ^ (eight[self.starts] & MASK[np.minimum(left, 8)]))
        at, behind = np.flatnonzero(left > 8), 8
        while len(at):
            out[at] = mix(out[at] ^ (eight[self.starts[at] + behind] & MASK[np.minimum(left[at] - behind, 8)]))
            behind += 8
            at = at[left[at] > behind]
        return out

    def room(self) -> np.ndarray:
        """Words from each word to the end of its row, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))


def words_of(column: pa.Array, lowered: bool = False, apart: np.ndarray = _SPACE) -> Words:
    """Words of a text column; `apart` tells the bytes between words."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    begin, end = int(offsets[0]), int(offsets[-1])
    data = np.zeros(end - begin + 7, dtype=np.uint8)
    if end > begin:
        data[:-7] = np.frombuffer(column.buffers()[2], np.uint8, end - begin, begin)
    offsets = offsets - begin
    size = end - begin
    inside = ~apart[data[:size]]
    if lowered:
        data[:size] = _LOWER[data[:size]]
    # Whether each byte begins a word: the byte in front is between words or of another row.
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    closes[tails] = inside[tails]
    if size:
        closes[size - 1] = inside[size - 1]
    starts = np.flatnonzero(opens)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each word on; too near the end it is no use, see `room`."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(min(size, len(hashes))):
        weight = np.uint64(int(mix(np.array([k + 1 + 1000 * size], dtype=np.uint64))[0]) | 1)
        out[: len(hashes) - k] += hashes[k:] * weight
    return mix(out)


def give_back() -> None:
    """Return freed memory to the system; a Python worker lives on behind its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of `column` hold about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        sums = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = sums[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sums, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


ASKED_BITS = 23


def asked_rows(docs: DataFrame, asked: DataFrame, name: str, then=None, schema=None) -> DataFrame:
    """Rows of `docs` whose id `name` is in `asked`, and a few others; the id's column must not be null.

    A bit table of fixed size travels to the tasks, so no text is shuffled to find
    out. Executors send places of the table, each once: 2^23 at most. `then` turns
    the batches into those of `schema` in the same Python worker.
    """
    place = F.pmod(F.xxhash64(name), F.lit(1 << ASKED_BITS))
    places = asked.select(place.alias("_place")).distinct().toArrow()
    table = np.zeros(1 << ASKED_BITS, dtype=bool)
    table[places["_place"].to_numpy()] = True
    bits = np.packbits(table, bitorder="little")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["_place"].to_numpy()
            yield batch.drop_columns(["_place"]).filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(held(batches))

    placed = docs.withColumn("_place", place)
    return placed.mapInArrow(held, docs.schema) if then is None else placed.mapInArrow(answered, schema)


def ragged(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
