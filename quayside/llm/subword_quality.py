"""Quality scores from learned subword embeddings.

A document is the mean of vectors of its words, of its pairs of neighbouring
words (a word behind itself is a feature of its own) and of its character n-grams within a word (the white space around a word
counts as its borders), all hashed into one table; a softmax over two classes
follows. Vectors and output weights are fitted in numpy by stochastic gradient
descent, one document at a time, on a bounded sample of labelled documents.

The model is linear behind the vectors, so scoring needs one number per hashed
feature, the difference of the two classes: a table of fixed size for each task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quayside.llm.common import free_name, grams, slices, words_of
from quayside.llm.labelled import training_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 4000  # labelled documents it is fitted on, at most
SAMPLE_BYTES = 50_000  # longer ones are not fitted on
BITS = 17
DIMENSIONS = 16
EPOCHS = 8
RATE = 0.5
CHARACTERS = (2, 4)
THRESHOLD = 0.3

_SLOTS = (1 << BITS) - 1
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Subwords:
    """What each hashed feature adds to the log odds of label 1, and the bias."""

    lift: np.ndarray
    bias: float


def _features(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of a slice, kind by kind, each with the row it is of."""
    words = words_of(part["text"], True)
    rows = words.rows
    hashes = words.hashes(7)
    yield _slot(hashes), rows
    paired = np.flatnonzero(words.room() > 1)
    yield _slot(grams(hashes, 2)[paired]), rows[paired]
    # A word behind itself: one feature whatever the word is.
    again = paired[hashes[paired] == hashes[np.minimum(paired + 1, len(hashes) - 1)]] if len(paired) else paired
    yield np.zeros(len(again), dtype=np.int32), rows[again]
    data = words.data
    size = len(data) - 7
    if size:
        ends = np.cumsum(pc.fill_null(pc.binary_length(part["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        row = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(ends, prepend=0))
        white = (data[:size] == 0x20) | ((data[:size] >= 0x09) & (data[:size] <= 0x0D))
        text = np.where(white, np.uint8(0x20), data[:size])
        text = np.concatenate([text, np.zeros(7, dtype=np.uint8)])
        eight = np.ndarray((size,), "<u8", text, 0, (1,))
        for n in CHARACTERS:
            ok = np.ones(size, dtype=bool)
            for k in range(1, n - 1):  # white space only at the borders
                ok[: size - k] &= ~white[k:]
            ok[: size - n + 1] &= row[n - 1 :] == row[: max(size - n + 1, 0)]
            ok[max(size - n + 1, 0) :] = False
            at = np.flatnonzero(ok)
            bits = eight[at] & np.uint64((1 << 8 * n) - 1)
            yield (((bits + np.uint64(n)) * _MULTIPLY) >> np.uint64(64 - BITS)).astype(np.int32), row[at]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def train_subwords(
    docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES
) -> Subwords:
    """Fit on at most `rows` labelled documents of at most `longest` bytes, outside the held-out fold.

    Executors send each sample document's distinct features and their shares.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            kinds = list(_features(part))
            keys = np.concatenate([r.astype(np.int64) << BITS | f for f, r in kinds])
            pairs, counts = np.unique(keys, return_counts=True)
            bounds = np.searchsorted(pairs >> BITS, np.arange(part.num_rows + 1)).tolist()
            slots = (pairs & _SLOTS).astype("<u4")
            counts = counts.astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([slots[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    part["label"], part["_id"],
                ],
                names=["slots", "counts", "label", "id"],
            )

    texts = training_texts(docs, labels, label, rows, longest)
    got = texts.mapInArrow(counted, "slots binary, counts binary, label int, id long").collect()
    got = sorted(got, key=lambda r: (r["id"], r["slots"]))
    return fit_subwords(
        [(np.frombuffer(bytes(r["slots"]), "<u4"), np.frombuffer(bytes(r["counts"]), "<f4")) for r in got],
        np.array([r["label"] for r in got], dtype=np.int64),
    )


def fit_subwords(
    samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE
) -> Subwords:
    """Stochastic gradient descent on the softmax loss; `samples` are features and counts of each document."""
    draw = np.random.default_rng(5)
    vectors = draw.uniform(-1, 1, (1 << BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output = np.zeros((2, DIMENSIONS), dtype=np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = np.array([0.0, np.log(share / (1 - share))], dtype=np.float32)
    known = [k for k in range(len(labels)) if len(samples[k][0])]
    for epoch in range(epochs if 0 < labels.sum() < len(labels) else 0):
        step = rate * (1 - epoch / epochs)
        for k in draw.permutation(known):
            slots, counts = samples[k]
            shares = counts / counts.sum()
            mean = shares @ vectors[slots]
            logits = output @ mean + bias
            odds = np.exp(logits - logits.max())
            wrong = odds / odds.sum()
            wrong[labels[k]] -= 1
            back = wrong @ output
            output -= step * np.outer(wrong, mean)
            bias -= 0.1 * step * wrong
            # Vectors move by their share, scaled up as a document has many.
            vectors[slots] -= (step * 50) * shares[:, None] * back
    lift = vectors @ (output[1] - output[0])
    return Subwords(lift.astype(np.float32), float(bias[1] - bias[0]))


def score_quality(docs: DataFrame, model: Subwords) -> DataFrame:
    """All columns of `docs` with `_score`, or what `free_name` makes of it, the probability of label 1.

    A null or empty text has no features and the score of the bias.
    """

    name = free_name(docs, "_score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sums, counts = np.zeros(part.num_rows), np.zeros(part.num_rows)
            for slots, rows in _features(part):
                sums += np.bincount(rows, model.lift[slots], part.num_rows)
                counts += np.bincount(rows, minlength=part.num_rows)
            odds = np.clip(sums / np.maximum(counts, 1) + model.bias, -30, 30)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(1 / (1 + np.exp(-odds)))], names=[*part.schema.names, name]
            )

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
