"""Token ids of documents in framed binary records, with a separate offset index.

A record is: length of the payload (8 bytes), masked CRC-32C of those 8 bytes
(4), the payload, masked CRC-32C of the payload (4); all little-endian. The
framing is the one record readers of training frameworks know. A payload is the
document's id (8 bytes, signed; the least value stands for null) and its token
ids, two bytes each where the vocabulary fits in 65,536 ids, else four.

The index is a Parquet table with one row per record: file, offset, length, id,
number of tokens, tokens in front. It alone says which files count: a task that is
run again writes a file of another name, and only the index rows of the attempt
that Spark commits are kept. With the index, records can be read in any order.
"""

from __future__ import annotations

import functools
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.common import Words, slices, words_of
from quayside.session import work_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
NO_ID = -(2**63)
END = 0
# Fixed values of the record framing: the polynomial, reflected, and what the mask adds.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

_BLOCK = 256
# Arrays over a slice take a hundred times its bytes, and the encoder stays in its Python worker behind the task.
_SLICE_BYTES = 1 << 20
_INDEX = "file string, offset long, length long, doc_id long, n_tokens long, before long, width int"


@functools.cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for four bytes at a time, and for moving a checksum over 2^k blocks of zeros."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    step = [one]
    for _ in range(3):
        step.append((step[-1] >> 8) ^ one[step[-1] & 0xFF])
    four = np.array(step[::-1])
    # A checksum is linear in its bits: columns say where each bit goes.
    column = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(_BLOCK // 4):
        column = _four(four, column)
    moves = []
    for _ in range(40):
        move = np.zeros((4, 256), dtype=np.uint32)
        for byte in range(4):
            for bit in range(8):
                move[byte, ((np.arange(256) >> bit) & 1).astype(bool)] ^= column[8 * byte + bit]
        moves.append(move)
        column = _four(move, column)
    return four, moves


def _four(four: np.ndarray, x: np.ndarray) -> np.ndarray:
    return four[0][x & 0xFF] ^ four[1][(x >> 8) & 0xFF] ^ four[2][(x >> 16) & 0xFF] ^ four[3][x >> 24]


def masked_checksums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each record `data[offsets[i]:offsets[i + 1]]`, none shorter than 4 bytes.

    Zeros in front leave a checksum that began at nought unchanged, so records are
    filled up in front to whole blocks; all blocks of all records step together.
    """
    four, moves = _tables()
    sizes = np.diff(offsets)
    blocks = -(-sizes // _BLOCK)
    ends = np.cumsum(blocks)
    padded = np.zeros(int(ends[-1]) * _BLOCK, dtype=np.uint8)
    begins = ends * _BLOCK - sizes
    at = np.arange(len(data)) + np.repeat(begins - offsets[:-1], sizes)
    padded[at] = data[offsets[0] : offsets[-1]] if offsets[0] else data
    for byte in range(4):  # the usual start value
        padded[begins + byte] ^= 0xFF
    grid = padded.view("<u4").reshape(-1, _BLOCK // 4)
    sums = np.zeros(len(grid), dtype=np.uint32)
    for column in grid.T.copy():
        sums = _four(four, sums ^ column)
    behind = np.repeat(ends, blocks) - 1 - np.arange(len(grid))
    for bit in range(int(behind.max()).bit_length()):
        far = ((behind >> bit) & 1).astype(bool)
        sums[far] = _four(moves[bit], sums[far])
    whole = ~np.bitwise_xor.reduceat(sums, ends - blocks)
    return ((whole >> 15) | (whole << 17)) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Framed records one behind the other, and where each payload's record begins."""
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    heads = sizes.astype("<u8").view(np.uint8)
    head_sums = masked_checksums(heads, np.arange(len(payloads) + 1) * 8).astype("<u4")
    body = np.frombuffer(b"".join(payloads), np.uint8)
    sums = masked_checksums(body, np.concatenate([[0], np.cumsum(sizes)])).astype("<u4")
    parts = []
    for k, payload in enumerate(payloads):
        parts += (heads[8 * k : 8 * k + 8].tobytes(), head_sums[k].tobytes(), payload, sums[k].tobytes())
    return b"".join(parts), np.concatenate([[0], np.cumsum(sizes + 16)])[:-1]


def unframe(block: bytes, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Payloads of the records at `starts`; raises ValueError where a length or checksum is wrong."""
    data = np.frombuffer(block, np.uint8)
    payloads = [block[s + 12 : s + 12 + n] for s, n in zip(starts.tolist(), lengths.tolist())]
    heads = b"".join(block[s : s + 8] for s in starts.tolist())
    told = np.frombuffer(b"".join(block[s + 8 : s + 12] for s in starts.tolist()), "<u4")
    said = np.frombuffer(b"".join(block[s + 12 + n : s + 16 + n] for s, n in zip(starts.tolist(), lengths.tolist())), "<u4")
    count = len(payloads)
    if len(data) and (
        (np.frombuffer(heads, "<u8") != lengths).any()
        or (masked_checksums(np.frombuffer(heads, np.uint8), np.arange(count + 1) * 8) != told).any()
        or (masked_checksums(np.frombuffer(b"".join(payloads), np.uint8), np.concatenate([[0], np.cumsum(lengths)])) != said).any()
    ):
        raise ValueError("a record's length or checksum is wrong")
    return payloads


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Encoder:
    """Token ids of texts, with the library asked once for each distinct piece.

    The vocabulary's pattern never joins what stands on both sides of a single
    white space between characters that are none: the white space begins the next
    match. So texts are cut there, and ids of the pieces in a row are the ids of the
    text. Names of special tokens in a text are what the library makes of them; a
    vocabulary whose names hold white space is asked text by text.
    """

    KEPT = 1 << 18  # pieces remembered between slices

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = any(c.isspace() for t in added for c in t)
        self.width = 2 if self.library.get_vocab_size() <= 65536 else 4
        # A byte-level token has one character for each byte.
        self.bytes = np.zeros(self.library.get_vocab_size(), dtype=np.int64)
        for token, i in self.library.get_vocab().items():
            self.bytes[i] = len(token)
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.ids = np.zeros(0, f"<u{self.width}")
        self.counts = np.zeros(0, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one behind the other, and how many each row has."""
        if self.whole:
            return self._each(column)
        pieces, dark = _pieces(column)
        keys, checks = pieces.hashes(1), pieces.hashes(2)
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if (checks[at][inverse] != checks).any():  # two pieces of one hash: each by itself
            return self._each(column)
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[place] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if (self.checks[place[known]] != checks[at[known]]).any():
            return self._each(column)
        fresh = at[~known]
        if len(fresh):
            self._learn(keys[fresh], checks[fresh], *self._ask(pieces, dark, fresh))
            place = np.searchsorted(self.keys, distinct)
        begins = np.cumsum(self.counts) - self.counts
        sizes = self.counts[place][inverse]
        flat = self.ids[_runs(begins[place][inverse], sizes)]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return flat, np.diff(sums[pieces.first])

    def _ask(self, pieces: Words, dark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces, and how many each has.

        Pieces that begin and end as a cut does are put together into one text: the
        bytes that each id stands for tell where a piece ends.
        """
        raw, starts, ends = pieces.data, pieces.starts[at], pieces.ends[at]
        plain = (ends - starts > 1) & dark[ends - 1] & dark[np.minimum(starts + 1, ends - 1)]
        plain &= (raw[starts] == 0x20) | ((raw[starts] >= 0x09) & (raw[starts] <= 0x0D))
        counts = np.zeros(len(at), dtype=np.int64)
        lists = self._library([raw[s:e].tobytes().decode() for s, e in zip(starts[~plain].tolist(), ends[~plain].tolist())])
        counts[~plain] = [len(one) for one in lists]
        whole = raw[_runs(starts[plain], (ends - starts)[plain])].tobytes().decode()
        joined = np.array(self._library([whole])[0] if whole else [], dtype=np.int64)
        stops = np.cumsum((ends - starts)[plain])
        counts[plain] = np.diff(np.searchsorted(np.cumsum(self.bytes[joined]), stops, side="right"), prepend=0)
        ids = np.zeros(int(counts.sum()), self.ids.dtype)
        begins = np.cumsum(counts) - counts
        ids[_runs(begins[plain], counts[plain])] = joined
        ids[_runs(begins[~plain], counts[~plain])] = [i for one in lists for i in one]
        return ids, counts

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        counts = np.concatenate([self.counts, counts])
        ids = np.concatenate([self.ids, ids])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        begins = np.cumsum(counts) - counts
        self.ids = ids[_runs(begins[order], counts[order])]
        self.keys, self.counts = keys[order], counts[order]
        self.checks = np.concatenate([self.checks, checks])[order]

    def forget(self) -> None:
        """Start anew when more pieces are remembered than `KEPT`."""
        if len(self.keys) > self.KEPT:
            self.keys, self.checks = self.keys[:0], self.checks[:0]
            self.ids, self.counts = self.ids[:0], self.counts[:0]

    def _each(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self._library([t or "" for t in column.to_pylist()])
        return np.array([i for f in found for i in f], self.ids.dtype), np.array([len(f) for f in found], np.int64)


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions `begins[i] .. begins[i] + sizes[i] - 1` for each i, one behind the other."""
    sums = np.cumsum(sizes)
    return np.arange(int(sums[-1]) if len(sums) else 0) + np.repeat(begins - (sums - sizes), sizes)


# The white space of Unicode beyond ASCII, as UTF-8.
_WHITE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _dark(data: np.ndarray) -> np.ndarray:
    """Bytes of characters that are neither white space, of all Unicode, nor control characters."""
    dark = data > 0x20
    if not (data >= 0x80).any():
        return dark
    for size in (2, 3):
        codes = sorted(int.from_bytes(w, "big") for w in _WHITE if len(w) == size)
        first = np.flatnonzero(np.isin(data[: len(data) - size + 1], [c >> 8 * (size - 1) for c in codes]))
        code = sum(data[first + k].astype(np.int64) << 8 * (size - 1 - k) for k in range(size))
        white = first[np.isin(code, codes)]
        for k in range(size):
            dark[white + k] = False
    return dark


def _pieces(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Texts cut in front of each single white space that has other characters on both sides; which bytes are dark."""
    words = words_of(column, apart=np.zeros(256, dtype=bool))
    data, rows = words.data[:-7], len(words.first) - 1
    dark = _dark(data)
    cut = np.zeros(len(data), dtype=bool)
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    if len(data) > 2:
        cut[1:-1] = white[1:-1] & dark[:-2] & dark[2:]
    # A row's last byte and what follows it are of different rows.
    cut[words.ends - 1] = False
    cut[words.starts] = True
    starts = np.flatnonzero(cut)
    heads = np.zeros(rows + 1, dtype=np.int64)
    sizes = np.zeros(rows, dtype=np.int64)
    sizes[np.diff(words.first) > 0] = words.ends - words.starts
    np.cumsum(sizes, out=heads[1:])
    return Words(words.data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, heads)), dark


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_records(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, partitions: int | None = None
) -> DataFrame:
    """Encode `text` of each row, write record files and their index below `path`; return the index.

    Files hold the rows in ascending `doc_id` (null first, equal ids in any
    order). A null text counts as empty: its record holds the end id alone. Other
    columns are not looked at. An empty table makes an empty index and no file.
    `path` must be a folder that all executors see, with a scheme pyarrow knows.
    """
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(vocabulary)
        width = encoder.width
        tail = np.array([end], f"<u{width}").tobytes()
        store, root = _place(path)
        file = f"records-{uuid.uuid4().hex}.bin"
        stream, offset, before = None, 0, 0
        for part in slices(batches, "text", _SLICE_BYTES):
            if stream is None:
                stream = store.open_output_stream(f"{root}/{file}")
            encoder.forget()
            flat, counts = encoder.encode(part["text"])
            ids = [NO_ID if i is None else i for i in part["doc_id"].to_pylist()]
            stops = np.cumsum(counts).tolist()
            counts = counts + 1
            payloads = [
                i.to_bytes(8, "little", signed=True) + flat[a:b].tobytes() + tail
                for i, a, b in zip(ids, [0, *stops], stops)
            ]
            block, starts = frame(payloads)
            stream.write(block)
            sums = np.cumsum(counts)
            size = len(payloads)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * size), pa.array(starts + offset), pa.array([len(p) for p in payloads], pa.int64()),
                    part["doc_id"].cast(pa.int64()), pa.array(counts), pa.array(sums - counts + before),
                    pa.array(np.full(size, width, dtype=np.int32)),
                ],
                names=["file", "offset", "length", "doc_id", "n_tokens", "before", "width"],
            )
            offset += len(block)
            before += int(sums[-1])
        if stream is not None:
            stream.close()

    store, root = _place(path)
    store.create_dir(root, recursive=True)
    placed = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(count, "doc_id")
        .sortWithinPartitions("doc_id")
    )
    placed.mapInArrow(write, _INDEX).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index below `path` with `start`: the tokens of all records in front.

    Only the sums of files, one row each, are added up in one place.
    """
    index = spark.read.schema(_INDEX).parquet(f"{path.rstrip('/')}/index")
    sums = index.groupBy("file").agg(
        F.sum("n_tokens").alias("_tokens"), F.min("doc_id").alias("_from"), F.max("doc_id").alias("_to")
    )
    order = Window.orderBy(F.col("_from").asc_nulls_first(), F.col("_to").asc_nulls_first(), "file")
    front = sums.select(
        "file",
        F.coalesce(F.sum("_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_front"),
    )
    return index.join(front, "file").withColumn("start", F.col("_front") + F.col("before")).drop("_front")


def read_records(index: DataFrame, path: str, seed: int | None = None) -> DataFrame:
    """Read the records that `index` names; each is checked against its checksums.

    Gives `doc_id`, `start`, `n_tokens` and `ids` (binary, four little-endian bytes
    per id). With a `seed` the records come in an order drawn from it.
    """
    path = path.rstrip("/")
    if seed is not None:
        index = index.orderBy(F.xxhash64(F.lit(seed), "file", "offset"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(path)
        opened: dict[str, object] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids: list[bytes | None] = [None] * part.num_rows
                files = np.array(part["file"].to_pylist())
                offsets, lengths = part["offset"].to_numpy(), part["length"].to_numpy()
                width = part["width"].to_numpy()
                for file in dict.fromkeys(files.tolist()):
                    if file not in opened:
                        opened.clear()
                        opened[file] = store.open_input_file(f"{root}/{file}")
                    mine = np.flatnonzero(files == file)
                    mine = mine[np.argsort(offsets[mine], kind="stable")]
                    # Records that stand together are read together.
                    gaps = np.flatnonzero(offsets[mine][1:] != (offsets + lengths + 16)[mine][:-1]) + 1
                    for run in np.split(mine, gaps):
                        begin = int(offsets[run[0]])
                        size = int(offsets[run[-1]] + lengths[run[-1]]) + 16 - begin
                        block = opened[file].read_at(size, begin)
                        for k, payload in zip(run.tolist(), unframe(block, offsets[run] - begin, lengths[run])):
                            ids[k] = np.frombuffer(payload, f"<u{width[k]}", offset=8).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["start"], part["n_tokens"], pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return index.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write `docs` as records, read them back: `doc_id`, `start`, `n_tokens`, `ids_crc32`."""
    path = path or work_dir(docs.sparkSession, "records")
    index = write_records(docs, path, vocabulary)
    return read_records(index, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def checksum(ids: list[int]) -> int:
    """What `ids_crc32` is for a list of ids."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
