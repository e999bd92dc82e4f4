"""Toxic spans and scores from a linear-chain conditional random field.

The field has two states per word (offending or not), weights for the hashed
word itself, its beginnings, the word in front and the word behind, and weights
between neighbouring states. It is fitted in numpy on the driver on a bounded sample of
labelled documents: words and beginnings that toxic documents hold far more often
than others mark the offending words of toxic documents, which gives each word
its label. Marginals of a document's words and their number give its score,
fitted to its label.

Scoring runs in Arrow batches on the executors; all documents of a slice form
one chain that starts anew at each document. The recursion is a product of two
by two matrices, so chunks of the chain are multiplied side by side.
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

from quayside.llm.common import MASK, Words, free_name, mix, slices, words_of
from quayside.llm.labelled import training_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 4000  # labelled documents it is fitted on, at most
SAMPLE_BYTES = 20_000  # longer ones are not fitted on
BITS = 18  # hashed words
BEGINNINGS = (4, 5, 6, 7)  # bytes
ROUNDS = 25
THRESHOLD = 0.5
SLICE_BYTES = 1 << 20  # of texts scored together
BLOCK_WORDS = 100_000  # words that one step of fitting looks at together

# Words here are runs of letters, digits and bytes of other alphabets.
_APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LIMIT = 30.0


@dataclass
class Field:
    """Weights of words (in front, behind, itself, its beginnings), bias, states, and of the document's score."""

    words: np.ndarray  # kinds x 2^BITS
    bias: float
    states: np.ndarray  # 2 x 2
    score: np.ndarray


def _slots(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word and beginnings (one row each), and whether a word begins a document."""
    head = np.zeros(len(words.starts) + 1, dtype=bool)
    head[words.first] = True
    kinds = [words.hashes()]
    if len(words.starts):
        eight = np.ndarray((len(words.data) - 7,), "<u8", words.data, 0, (1,))[words.starts]
        sizes = words.ends - words.starts
        kinds += [mix((eight & MASK[np.minimum(sizes, n)]) + np.uint64(n)) for n in BEGINNINGS]
    else:
        kinds *= 1 + len(BEGINNINGS)
    return (np.stack(kinds) & np.uint64((1 << BITS) - 1)).astype(np.int32), head[:-1]


def _energies(field: Field, slots: np.ndarray, head: np.ndarray) -> np.ndarray:
    out = np.full(slots.shape[1], field.bias)
    for weights, kind in zip(field.words[2:], slots):
        out += weights[kind]
    out[1:] += np.where(head[1:], 0, field.words[0][slots[0, :-1]])
    out[:-1] += np.where(head[1:], 0, field.words[1][slots[0, 1:]])
    return np.clip(out, -_LIMIT, _LIMIT)


def _products(m: np.ndarray, backward: bool) -> np.ndarray:
    """Running products of matrices `m` (4 x steps x chunks), each scaled to sum 1."""
    out = np.empty_like(m)
    steps = range(m.shape[1])
    before = None
    for k in reversed(steps) if backward else steps:
        if before is None:
            now = m[:, k]
        else:
            a, b = (m[:, k], before) if backward else (before, m[:, k])
            now = np.stack([
                a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3],
                a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
            ])
        before = now / now.sum(axis=0)
        out[:, k] = before
    return out


def messages(energies: np.ndarray, head: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages (2 x words), each scaled to sum 1."""
    size = len(energies)
    steps = max(1, min(256, int(size**0.5)))
    chunks = -(-size // steps)
    e = np.zeros(steps * chunks)
    e[:size] = energies
    begins = np.ones(steps * chunks, dtype=bool)
    begins[:size] = head
    gain, s = np.exp(e), np.exp(states)
    # A document's first word forgets what was in front: both rows are alike.
    m = np.stack([np.full(len(e), s[0, 0]), s[0, 1] * gain, np.where(begins, s[0, 0], s[1, 0]),
                  np.where(begins, s[0, 1], s[1, 1]) * gain])
    m = (m / m.sum(axis=0)).reshape(4, chunks, steps).transpose(0, 2, 1).copy()
    front = _products(m, backward=False)
    entering = np.empty((2, chunks))
    one, two = 1.0, 0.0
    for c, (p0, p1, p2, p3) in enumerate(front[:, -1].T.tolist()):
        entering[0, c], entering[1, c] = one, two
        one, two = one * p0 + two * p2, one * p1 + two * p3
        one, two = one / (one + two), two / (one + two)
    alpha = np.stack([entering[0] * front[0] + entering[1] * front[2], entering[0] * front[1] + entering[1] * front[3]])
    behind = _products(m, backward=True)
    leaving = np.empty((2, chunks))
    one = two = 0.5
    whole = behind[:, 0].T.tolist()
    for c in range(chunks - 1, -1, -1):
        leaving[0, c], leaving[1, c] = one, two
        p0, p1, p2, p3 = whole[c]
        one, two = p0 * one + p1 * two, p2 * one + p3 * two
        one, two = one / (one + two), two / (one + two)
    beta = np.empty_like(alpha)
    beta[0, -1], beta[1, -1] = leaving
    beta[0, :-1] = behind[0, 1:] * leaving[0] + behind[1, 1:] * leaving[1]
    beta[1, :-1] = behind[2, 1:] * leaving[0] + behind[3, 1:] * leaving[1]
    alpha, beta = (x.transpose(0, 2, 1).reshape(2, -1)[:, :size] for x in (alpha, beta))
    return alpha / alpha.sum(axis=0), beta / beta.sum(axis=0)


def marginals(field: Field, slots: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Probability that each word offends."""
    if not slots.shape[1]:
        return np.zeros(0)
    alpha, beta = messages(_energies(field, slots, head), head, field.states)
    both = alpha * beta
    return both[1] / both.sum(axis=0)


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document: log odds that any of its words offends, size, their product, expected share, 1."""
    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(x)])
        return np.maximum(sums[first[1:]] - sums[first[:-1]], 0.0)

    odds = np.log(np.expm1(np.clip(total(-np.log1p(-np.clip(p, 1e-9, 1 - 1e-9))), 1e-7, 30.0)))
    size = np.log1p(np.diff(first))
    share = np.log((total(p) + 1e-3) / (np.diff(first) + 1.0))
    return np.stack([odds / 10, size / 10, odds * size / 100, share / 10, np.ones_like(odds)], axis=1)


def _word_labels(slots: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for the offending words of toxic documents, 0 for all others.

    Words offend that toxic documents hold significantly more often than others.
    Once some are found, toxic documents that hold them are explained and no longer
    count as toxic, so what else they hold does not come to offend.
    """
    size = 1 << BITS
    kinds = slots.shape[0]
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    space = kinds * size
    # Distinct units of each document, kind by kind.
    met = [np.unique(rows << BITS | kind) for kind in slots.astype(np.int64)]
    row = np.concatenate([m >> BITS for m in met]).astype(np.int32)
    unit = np.concatenate([(m & (size - 1)) + k * size for k, m in enumerate(met)]).astype(np.int32)
    del met
    good = np.bincount(unit[toxic[row] == 0], minlength=space)
    n_good = int((toxic == 0).sum())
    offends, open_ = np.zeros(space, dtype=bool), toxic == 1
    for _ in range(12):
        n_bad = int(open_.sum())
        bad = np.bincount(unit[open_[row]], minlength=space)
        odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
        # Significance by how many toxic documents would hold it if they were like the others.
        expected = (good + 0.5) * (n_bad / (n_good + 1))
        surplus = (bad - expected) / np.sqrt(expected + 1)
        found = (surplus > 5.0) & (odds > 1.5) & ~offends
        if not found.any():
            break
        # The strongest first; others are judged on what those leave open.
        offends |= found & (surplus >= 0.7 * surplus[found].max())
        open_[row[offends[unit]]] = False
    marked = np.zeros(slots.shape[1], dtype=bool)
    for k, kind in enumerate(slots):
        marked |= offends[k * size : (k + 1) * size][kind]
    return (marked & (toxic[rows] == 1)).astype(np.float64)


def _logistic(inputs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, by Newton's steps with a little weight decay."""
    w = np.zeros(inputs.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -_LIMIT, _LIMIT)))
        gradient = inputs.T @ (p - y) + 1e-2 * w
        curve = (inputs * (p * (1 - p))[:, None]).T @ inputs + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    return w


def fit_field(slots: np.ndarray, first: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Fit by gradient steps of adaptive size on the log-likelihood of the word labels."""
    size = 1 << BITS
    kinds = slots.shape[0]
    field = Field(np.zeros((2 + kinds, size), dtype=np.float32), -4.0, np.zeros((2, 2)), np.zeros(5))
    if not len(toxic) or toxic.min() == toxic.max():
        # Nothing to tell apart: the same score for all.
        share = float(toxic.mean()) if len(toxic) else 0.0
        field.score[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return field
    y = _word_labels(slots, first, toxic)
    # Blocks of whole documents; a gradient is the sum over them.
    cuts = np.unique(np.searchsorted(first, np.arange(0, first[-1] + BLOCK_WORDS, BLOCK_WORDS)))
    cuts = np.unique(np.append(cuts[cuts < len(first)], len(first) - 1)).tolist()
    blocks = [(first[a], first[b], first[a : b + 1] - first[a]) for a, b in zip(cuts, cuts[1:]) if first[b] > first[a]]
    weight = max(y.sum(), 1.0)
    sums = [np.zeros((2 + kinds, size)), 0.0, np.zeros((2, 2))]
    pace = np.array([0.1, 0.1, *[0.5] * kinds])[:, None]
    for _ in range(rounds):
        steps = [1e-5 * field.words.astype(np.float64), 0.0, 1e-4 * field.states]
        for begin, end, inside in blocks:
            parts = _gradient(field, slots[:, begin:end], inside, y[begin:end])
            steps = [total + part / weight for total, part in zip(steps, parts)]
        sums = [a + b * b for a, b in zip(sums, steps)]
        field.words = (field.words - steps[0] / (np.sqrt(sums[0]) + 1e-6) * pace).astype(np.float32)
        field.bias -= 0.3 * steps[1] / (np.sqrt(sums[1]) + 1e-6)
        field.states = field.states - 0.1 * steps[2] / (np.sqrt(sums[2]) + 1e-6)
    p = np.concatenate([marginals(field, slots[:, a:b], _heads(inside)) for a, b, inside in blocks])
    field.score = _logistic(evidence(p, first), toxic)
    return field


def _heads(first: np.ndarray) -> np.ndarray:
    head = np.zeros(int(first[-1]) + 1, dtype=bool)
    head[first] = True
    return head[:-1]


def _gradient(field: Field, slots: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Of the negative log-likelihood, by weights of words, the bias and weights of states."""
    size, head = 1 << BITS, _heads(first)
    energies = _energies(field, slots, head)
    alpha, beta = messages(energies, head, field.states)
    wrong = alpha[1] * beta[1] / (alpha * beta).sum(axis=0) - y
    inner = ~head[1:]
    seen = [((1 - y[:-1]) * (1 - y[1:])), ((1 - y[:-1]) * y[1:]), (y[:-1] * (1 - y[1:])), (y[:-1] * y[1:])]
    s, gain = np.exp(field.states), np.exp(energies[1:])
    joint = np.stack([alpha[0, :-1] * s[0, 0] * beta[0, 1:], alpha[0, :-1] * s[0, 1] * gain * beta[1, 1:],
                      alpha[1, :-1] * s[1, 0] * beta[0, 1:], alpha[1, :-1] * s[1, 1] * gain * beta[1, 1:]])
    joint = (joint / joint.sum(axis=0) - np.stack(seen))[:, inner].sum(axis=1).reshape(2, 2)
    words = np.stack([
        np.bincount(slots[0, :-1][inner], wrong[1:][inner], size),
        np.bincount(slots[0, 1:][inner], wrong[:-1][inner], size),
        *[np.bincount(kind, wrong, size) for kind in slots],
    ])
    return words, float(wrong.sum()), joint


def train_field(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES
) -> Field:
    """Fit on at most `rows` labelled documents of at most `longest` bytes, outside the held-out fold."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part["text"], True, _APART)
            slots, _ = _slots(words)
            bounds = words.first.tolist()
            rows_ = [slots[:, a:b].T.tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.binary()), part["label"], part["_id"]], names=["slots", "label", "id"])

    texts = training_texts(docs, labels, label, rows, longest)
    got = sorted(texts.mapInArrow(hashed, "slots binary, label int, id long").collect(), key=lambda r: (r["id"], r["slots"]))
    kinds = 1 + len(BEGINNINGS)
    first = np.concatenate([[0], np.cumsum([len(r["slots"]) // (4 * kinds) for r in got])]).astype(np.int64)
    toxic = np.array([r["label"] for r in got], dtype=np.float64)
    slots = np.frombuffer(b"".join(bytes(r["slots"]) for r in got), np.int32).reshape(-1, kinds).T.copy()
    del got
    return fit_field(slots, first, toxic)


def score_toxicity(docs: DataFrame, field: Field) -> DataFrame:
    """All columns of `docs` with `_score` (0 to 1) and `_spans`, or what `free_name` makes of these names.

    `_spans` are the runs of words more likely offending than not: begin and end
    in characters, and the largest marginal. A null or empty text has the score of
    a text without evidence and no spans.
    """
    names = [free_name(docs, "_score"), free_name(docs, "_spans")]
    added = [
        T.StructField(names[0], T.DoubleType()),
        T.StructField(names[1], T.ArrayType(T.StructType([
            T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()),
            T.StructField("marginal", T.DoubleType()),
        ]))),
    ]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])
        for part in slices(batches, "text", SLICE_BYTES):
            words = words_of(part["text"], True, _APART)
            slots, head = _slots(words)
            p = marginals(field, slots, head)
            odds = evidence(p, words.first) @ field.score
            hit = p >= 0.5
            opens = np.flatnonzero(hit & (head | ~np.concatenate([[False], hit[:-1]])))
            closes = np.flatnonzero(hit & np.concatenate([head[1:] | ~hit[1:], [True]]))[: len(opens)]
            best = np.maximum.reduceat(np.append(p, 0.0), np.stack([opens, closes + 1], 1).ravel())[::2] if len(opens) else p[:0]
            chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            rows = np.searchsorted(words.first, opens, side="right") - 1
            text_begin = np.concatenate([[0], np.cumsum(_text_bytes(part["text"]))])[rows]
            spans = pa.StructArray.from_arrays(
                [
                    pa.array((chars[words.starts[opens]] - chars[text_begin]).astype(np.int32)),
                    pa.array((chars[words.ends[closes]] - chars[text_begin]).astype(np.int32)),
                    pa.array(best),
                ],
                fields=list(kind),
            )
            counts = np.bincount(rows, minlength=part.num_rows)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(1 / (1 + np.exp(-np.clip(odds, -_LIMIT, _LIMIT)))),
                 pa.ListArray.from_arrays(pa.array(offsets), spans)],
                names=[*part.schema.names, *names],
            )

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *added]))


def _text_bytes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
