"""Log-probabilities of texts from a hierarchical Pitman-Yor model of word pairs.

A restaurant for each class of words in front (2^CONTEXT_BITS hashed classes, one
of them the start of a text) shares one parent restaurant, that of single words;
its parent spreads over all words alike. Words are dishes, tokens customers. Each
table of a context restaurant is a customer of the parent.

Tokens are gathered by dish: all contexts of a word meet in one bucket, so the
parent's customers of that word are at hand, and what a bucket needs of others
are totals per context restaurant, a table of fixed size. Predictions depend on
the number of tables of each pair alone, so that is the state of the sampler: a
sweep seats all customers of each pair, and of each word in the parent, again as
one block, given the tables of the others. Pairs of up to `SHORT` customers are
drawn from their exact distribution (generalised Stirling numbers), longer ones by
Metropolis steps with a proposal close to it. Predictive probabilities are averages
over the seatings of several sweeps. Draws are seeded by bucket, so a task that is
run again seats alike.

Buckets are rows of a written table: word pairs with their counts in one column,
the documents of their tokens in another. Each later step is one pass over it.

A word with more tokens than an average bucket is split by its contexts over buckets
of its own, as many as its tokens ask for. Each of them knows the word's tables and
tokens in the others from the pass before, as it knows all other totals.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import give_back, mix, remainder, slices, words_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS = 10
CONTEXT_BITS = 16
BUCKETS = 128  # at least; otherwise four times the shuffle partitions
STRENGTH = 1.0
BURN_IN = 2
SAMPLES = 3
SHORT = 128  # customers up to which a draw is exact
PARENT_STEPS = 4  # the parent's customers change between sweeps, so its draws begin anew

_CONTEXTS = 1 << CONTEXT_BITS
_END = np.uint64(0x5DEECE66D1234567)  # the end's hash; no word's hash is derived from it
_SLICE_ROWS = 1 << 16


@dataclass
class Hot:
    """Words with buckets of their own: hashes in order, the first bucket of each, and one behind the last."""

    words: np.ndarray
    first: np.ndarray

    def spread(self, hashes: np.ndarray, contexts: np.ndarray, to: np.ndarray) -> None:
        """Send tokens of such words, by context, to the buckets of their word."""
        if not len(self.words):
            return
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        mine = np.flatnonzero(self.words[at] == hashes)
        parts = np.diff(self.first)[at[mine]]
        to[mine] = self.first[at[mine]] + (mix(contexts[mine].astype(np.uint64) + np.uint64(7)) % parts.astype(np.uint64)).astype(np.int64)

    def siblings(self, bucket: int) -> range:
        """The buckets of a bucket's word; none for a bucket of many words."""
        if not len(self.words) or bucket < self.first[0]:
            return range(0)
        at = int(np.searchsorted(self.first, bucket, side="right")) - 1
        return range(int(self.first[at]), int(self.first[at + 1]))


def hot_words(docs: DataFrame, buckets: int) -> Hot:
    """Words with more tokens than an average bucket, which are fewer than buckets, from counts over all texts.

    Of each slice only words with a quarter of that share are counted, so the others of a
    word's tokens are too few to matter to where it goes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, _, _ = tokens_of(part["text"])
            words, counts = np.unique(hashes, return_counts=True)
            many = 4 * buckets * counts >= len(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(words[many], np.uint64(0)).view(np.int64)), pa.array(np.append(counts[many], len(hashes))),
                 pa.array(np.append(np.zeros(int(many.sum()), bool), True))],
                names=["word", "n", "whole"],
            )

    counted = docs.mapInArrow(count, "word long, n long, whole boolean").groupBy("whole", "word").agg(F.sum("n").alias("n"))
    whole = counted.agg(F.sum(F.when(F.col("whole"), F.col("n")))).first()[0] or 0
    found = counted.where(~F.col("whole") & (F.col("n") * buckets > whole)).select("word", "n").toArrow()
    words, n = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(words)
    parts = -(-n[order] * buckets // max(whole, 1))
    return Hot(words[order], buckets + np.concatenate([[0], np.cumsum(parts)]).astype(np.int64))


@dataclass
class Totals:
    """Sums over all buckets: customers and tables of contexts; tokens, words and tables of the parent; discounts."""

    customers: np.ndarray
    tables: np.ndarray
    tokens: int
    words: int
    parent_tables: float
    discount: float
    parent_discount: float
    shares: dict[int, int] | None = None  # tables of each bucket that was seated; without it, one per pair
    hot: Hot | None = None
    pieces: dict[int, tuple[int, int]] | None = None  # tokens and tables of each bucket of one word


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with freed memory given back behind each."""
    for batch in batches:
        yield batch
        give_back()


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


def _unpack(data, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<i8", len(kinds))
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, context class and row of each token of a text column; each row ends with an end."""
    words = words_of(column, True)
    counts = np.diff(words.first)
    rows = np.repeat(np.arange(len(counts)), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    hashes = np.empty(len(rows), dtype=np.uint64)
    inner = np.ones(len(rows), dtype=bool)
    inner[ends] = False
    hashes[inner], hashes[ends] = words.hashes(3), _END
    front = np.concatenate([hashes[-1:], hashes[:-1]])
    front[ends[:-1] + 1] = _END  # a text begins behind an end
    front[:1] = _END
    return hashes, (mix(front) >> np.uint64(64 - CONTEXT_BITS)).astype("<u2"), rows


def gather(docs: DataFrame, buckets: int, hot: Hot | None = None) -> DataFrame:
    """`docs` (`doc_id`, `text`, `fitted`) as buckets: `bucket`, `pairs`, `owners`; negative buckets list ids.

    `pairs`: distinct word hashes, pairs of each word, their contexts, fitted and all
    tokens of each pair. `owners`: slice and row of each token, pair by pair. Words in
    `hot` go to buckets behind the others.
    """
    every = buckets if hot is None else int(hot.first[-1])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for whole in slices(batches, "text"):
            for at in range(0, whole.num_rows, _SLICE_ROWS):
                part = whole.slice(at, _SLICE_ROWS)
                number += 1
                hashes, contexts, rows = tokens_of(part["text"])
                to = (mix(hashes.copy()) % np.uint64(buckets)).astype(np.int64)
                if hot is not None:
                    hot.spread(hashes, contexts, to)
                order = np.lexsort((hashes, to))
                hashes, contexts, rows, to = hashes[order], contexts[order], rows[order].astype("<u2"), to[order]
                bounds = np.searchsorted(to, np.arange(every + 1)).tolist()
                fitted = part["fitted"].to_numpy(zero_copy_only=False)[rows]
                data, held = [], [k for k in range(every) if bounds[k] < bounds[k + 1]]
                for a, b in ((bounds[k], bounds[k + 1]) for k in held):
                    distinct, counts = np.unique(hashes[a:b], return_counts=True)
                    data.append(_pack(distinct, counts.astype("<u4"), contexts[a:b], rows[a:b], np.packbits(fitted[a:b])))
                # Ids of the slice's rows and their numbers of tokens, for the end.
                ids = part["doc_id"].fill_null(0).to_numpy()
                present = np.packbits(part["doc_id"].is_valid().to_numpy(zero_copy_only=False))
                data.append(_pack(ids, present, np.bincount(rows, minlength=part.num_rows).astype("<i8")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*held, -number]), pa.array([number] * len(data)), pa.array(data, pa.binary())],
                    names=["bucket", "slice", "data"],
                )
                del hashes, contexts, rows, to, order, fitted, data
                give_back()

    def merge(table):
        bucket = table["bucket"][0].as_py()
        blobs, numbers = [x.as_buffer() for x in table["data"]], table["slice"].to_numpy()
        if bucket < 0:
            pairs, owners = blobs[0].to_pybytes(), b""
        else:
            keys, contexts, owners, fitted = [], [], [], []
            for number, blob in zip(numbers.tolist(), blobs):
                distinct, counts, context, row, bits = _unpack(blob, "<u8", "<u4", "<u2", "<u2", "u1")
                keys.append(np.repeat(distinct, counts))
                contexts.append(context)
                owners.append(np.full(len(row), number, "<i8") << 16 | row)
                fitted.append(np.unpackbits(bits, count=len(row)))
            del blobs
            keys, contexts = np.concatenate(keys), np.concatenate(contexts)
            owners, fitted = np.concatenate(owners), np.concatenate(fitted)
            order = np.lexsort((owners, contexts, keys))
            keys, contexts, owners, fitted = keys[order], contexts[order], owners[order], fitted[order].astype(np.int64)
            size = len(keys)
            new_word = np.concatenate([[True], keys[1:] != keys[:-1]])[:size]
            new_pair = (new_word | np.concatenate([[True], contexts[1:] != contexts[:-1]])[:size])
            at = np.flatnonzero(new_pair)
            taken = np.add.reduceat(fitted, at) if size else fitted
            every = np.diff(np.append(at, size))
            per_word = np.diff(np.append(np.flatnonzero(new_word[at]), len(at)))
            known, place = np.unique(owners >> 16, return_inverse=True)
            pairs = _pack(keys[new_word], per_word.astype("<u4"), contexts[at], taken.astype("<u4"), every.astype("<u4"))
            owners = _pack(known, place.astype("<u2" if len(known) < 65536 else "<u4"), (owners & 0xFFFF).astype("<u2"))
        return pa.table([pa.array([bucket]), pa.array([pairs], pa.binary()), pa.array([owners], pa.binary())],
                        names=["bucket", "pairs", "owners"])

    return (
        docs.mapInArrow(spread, "bucket long, slice long, data binary")
        .groupBy("bucket").applyInArrow(merge, "bucket long, pairs binary, owners binary")
    )


def _pairs(data) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word of each pair, its context, fitted and all tokens; and the number of words."""
    words, per_word, contexts, fitted, every = _unpack(data, "<u8", "<u4", "<u2", "<u4", "<u4")
    return np.repeat(np.arange(len(words)), per_word), contexts.astype(np.int64), fitted.astype(np.int64), every.astype(np.int64), words


def totals(buckets: DataFrame, hot: Hot | None = None) -> Totals:
    """Counts over all buckets, with one table per pair of a context and a word to begin with."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _each(batches):
            for bucket, data in zip(batch["bucket"].to_pylist(), batch["pairs"]):
                word, contexts, fitted, _, words = _pairs(data.as_buffer())
                held = fitted > 0
                customers = np.bincount(contexts, fitted, _CONTEXTS)
                tables = np.bincount(contexts[held], minlength=_CONTEXTS)
                per_word = np.bincount(word, fitted, len(words))
                met = np.bincount(word[held], minlength=len(words))
                seen = np.flatnonzero(customers)
                extra = [per_word.sum(), (per_word > 0).sum(), (fitted == 1).sum(), (fitted == 2).sum(),
                         (met == 1).sum(), (met == 2).sum()]
                piece = []
                if hot is not None and hot.siblings(bucket):
                    extra[1] = extra[4] = extra[5] = 0  # its word counts once, and has many contexts
                    piece = [-100 - bucket]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([seen, -1 - np.arange(6), piece]).astype(np.int64)),
                     pa.array(np.concatenate([customers[seen], extra, per_word.sum(keepdims=True)[: len(piece)]]).astype(np.int64)),
                     pa.array(np.concatenate([tables[seen], np.zeros(6), [held.sum()][: len(piece)]]).astype(np.int64))],
                    names=["context", "customers", "tables"],
                )

    got = (
        buckets.where("bucket >= 0").select("bucket", "pairs").mapInArrow(count, "context long, customers long, tables long")
        .groupBy("context").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).toArrow()
    )
    context, n, t = (got[c].to_numpy() for c in ("context", "customers", "tables"))
    extra, sums = np.zeros(6), (context < 0) & (context >= -6)
    extra[-1 - context[sums]] = n[sums]
    own = context <= -100
    pieces = {int(b): (int(a), int(c)) for b, a, c in zip(-100 - context[own], n[own], t[own])}
    if hot is not None:
        extra[1] += sum(any(pieces.get(b, (0, 0))[0] for b in range(a, e)) for a, e in zip(hot.first[:-1].tolist(), hot.first[1:].tolist()))
    customers, tables = np.zeros(_CONTEXTS), np.zeros(_CONTEXTS)
    customers[context[context >= 0]], tables[context[context >= 0]] = n[context >= 0], t[context >= 0]
    # Discounts by how many dishes have one customer and how many have two.
    share = [min(max((a + 0.5) / (a + 2 * b + 1), 0.05), 0.95) for a, b in ((extra[2], extra[3]), (extra[4], extra[5]))]
    return Totals(customers, tables, int(extra[0]), int(extra[1]), float(extra[1]), *share, hot=hot, pieces=pieces)


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    shift = np.zeros_like(z)
    for k in range(8):
        shift += np.log(z + k)
    z = z + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def stirling(size: int, discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: ways of n customers (rows) at t tables (columns), up to `size`."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(size):
        out[n + 1, 1:] = out[n, :-1]
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = np.logaddexp(out[n, :n], np.log(n - discount * t) + out[n, 1 : n + 1])
    return out


def _chosen(draw: np.random.Generator, logs: np.ndarray) -> np.ndarray:
    """A column for each row, by weights whose logarithms are given."""
    sums = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return (sums < draw.random((len(logs), 1)) * sums[:, -1:]).sum(axis=1)


class Dishes:
    """Tables of dishes with `customers` each, all customers of a dish seated at once.

    A dish with n customers has t tables with a chance proportional to S(n, t), the
    product over further tables of `pull` = chance * (strength + discount * tables in
    front), those of other dishes (`rest`) included.

    Above `SHORT` customers the state is where tables open: `early` tables among the
    first SHORT customers, and the places of later ones. A step proposes all of it
    anew: openings at place p come with a rate of pull * p^(d-1) / n^d, as they would
    if nobody but the first customer of a table were near; Metropolis decides with the
    exact weight of the places.
    """

    def __init__(
        self, draw: np.random.Generator, customers: np.ndarray, discount: float, strength: float, logs: np.ndarray | None = None
    ):
        self.draw, self.customers, self.discount, self.strength = draw, customers, discount, strength
        self.logs = stirling(SHORT, discount) if logs is None else logs
        order = np.argsort(customers, kind="stable")
        order = order[customers[order] > 1]
        cut = np.searchsorted(customers[order], SHORT, side="right")
        sizes, firsts = np.unique(customers[order[:cut]], return_index=True)
        self.groups = [(n, g) for n, g in zip(sizes.tolist(), np.split(order[:cut], firsts[1:]))]
        self.long = order[cut:]
        self.early, self.owner, self.place = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.steps = self.accepted = 0

    def seat(self, tables: np.ndarray, rest: np.ndarray, chance: np.ndarray, steps: int = 1) -> np.ndarray:
        """`tables` drawn again, with `steps` for long dishes; `rest` and `chance` belong to each dish."""
        tables = tables.copy()
        for n, group in self.groups:
            step = max(1, (1 << 19) // n)
            for at in (group[k : k + step] for k in range(0, len(group), step)):
                logs = np.log(chance[at, None] * (self.strength + self.discount * (rest[at, None] + np.arange(n))))
                logs[:, 0] = 0.0
                tables[at] = 1 + _chosen(self.draw, np.cumsum(logs, axis=1) + self.logs[n, 1 : n + 1])
        for _ in range(steps if len(self.long) else 0):
            tables[self.long] = self._step(rest[self.long], chance[self.long])
        return tables

    def _step(self, rest: np.ndarray, chance: np.ndarray) -> np.ndarray:
        n, d = self.customers[self.long].astype(np.float64), self.discount
        pull = chance * (self.strength + d * (rest + 1))
        share = (SHORT / n) ** d
        early = np.empty(len(n), dtype=np.int64)
        for a in range(0, len(n), 4096):
            logs = np.log(pull * share)[a : a + 4096, None] * np.arange(SHORT)
            early[a : a + 4096] = 1 + _chosen(self.draw, logs + self.logs[SHORT, 1:])
        owner = np.repeat(np.arange(len(n)), self.draw.poisson(pull / d * (1 - share)))
        low = share[owner]
        place = n[owner] * (low + self.draw.random(len(owner)) * (1 - low)) ** (1 / d)
        place = np.clip(np.ceil(place), SHORT + 1, n[owner]).astype(np.int64)
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])])[: len(owner)]
        owner, place = owner[new], place[new]
        if self.early is None:
            taken = np.ones(len(n), dtype=bool)
            self.early = early
        else:
            gain = self._weight(early, owner, place, rest, chance) - self._weight(self.early, self.owner, self.place, rest, chance)
            taken = np.log(self.draw.random(len(n))) < gain
            self.early = np.where(taken, early, self.early)
            self.steps, self.accepted = self.steps + len(n), self.accepted + int(taken.sum())
        stay, come = ~taken[self.owner], taken[owner]
        owner, place = np.concatenate([self.owner[stay], owner[come]]), np.concatenate([self.place[stay], place[come]])
        order = np.argsort(owner, kind="stable")  # places of one owner are in order
        self.owner, self.place = owner[order], place[order]
        return self.early + np.bincount(self.owner, minlength=len(n))

    def _weight(self, early: np.ndarray, owner: np.ndarray, place: np.ndarray, rest: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Logarithm of target over proposal, up to what all states of a dish share."""
        n, d = self.customers[self.long].astype(np.float64), self.discount
        later = np.bincount(owner, minlength=len(n))
        t = early + later
        pull = chance * (self.strength + d * (rest + 1))
        base = self.strength / d + rest + 1
        out = (t - 1) * np.log(chance * d) + _log_gamma(base + t - 1) - _log_gamma(base)
        out -= (early - 1) * np.log(pull * (SHORT / n) ** d)
        # Customers that join a table, between openings: a product of (seated - d * tables).
        index = np.arange(len(owner)) - (np.cumsum(later) - later)[owner]
        before = early[owner] + index
        p = place.astype(np.float64)
        out += _log_gamma(n - d * t) - _log_gamma(SHORT - d * early)
        rate = pull[owner] / d * (p**d - (p - 1) ** d) / n[owner] ** d
        each = _log_gamma(p - 1 - d * before) - _log_gamma(p - d * (before + 1)) - rate - np.log(-np.expm1(-rate))
        return out + np.bincount(owner, each, len(n))


class Seating:
    """Tables of a bucket's pairs, and of its words in the parent."""

    def __init__(self, bucket: int, data, sums: Totals, strength: float):
        self.word, self.context, self.customers, self.every, words = _pairs(data)
        self.words, self.sums, self.strength = len(words), sums, strength
        self.draw = np.random.default_rng(bucket)
        self.context_tables = sums.tables.copy()
        self.tables = np.minimum(self.customers, 1).astype(np.float64)
        self.parent_tables = np.zeros(self.words)
        self.parent_logs = stirling(SHORT, sums.parent_discount)
        self.share = (sums.shares or {}).get(bucket, self.tables.sum())
        # The word of a bucket that is one of several: what the others hold of it.
        siblings = sums.hot.siblings(bucket) if sums.hot is not None else range(0)
        others = [sums.pieces.get(b, (0, 0)) for b in siblings if b != bucket]
        self.tokens_elsewhere, self.tables_elsewhere = (sum(o[k] for o in others) for k in (0, 1))
        self.reports = not siblings or bucket == siblings[0]
        self._parent()
        self.several = np.flatnonzero(self.customers > 1)
        self.dishes = Dishes(self.draw, self.customers[self.several], sums.discount, strength)
        self.sweep()
        if sums.shares is not None:  # the totals hold these pairs' tables already
            self.context_tables = sums.tables.copy()

    @property
    def begins(self) -> np.ndarray:
        """First seat of each pair of several customers, where each customer has one."""
        count = self.customers[self.several]
        return np.cumsum(count) - count

    @property
    def sizes(self) -> np.ndarray:
        """A seating with these tables, by seats; sizes don't enter predictions, so the first table takes all it can."""
        count, tables = self.customers[self.several], self.tables[self.several].astype(np.int64)
        place = np.arange(int(count.sum())) - np.repeat(self.begins, count)
        out = (place < np.repeat(tables, count)).astype(np.int64)
        out[self.begins] += count - tables
        return out

    def _parent(self) -> None:
        """Seat the tables of all contexts in the parent; probabilities of words there."""
        s = self.sums
        customers = np.bincount(self.word, self.tables, self.words).astype(np.int64) + self.tables_elsewhere
        # Other buckets' tables grow as those of this one do.
        everyone = max(float(s.tables.sum()) * float(self.tables.sum()) / max(self.share, 1), 1.0)
        even = np.full(self.words, 1 / (s.words + 1))
        dishes = Dishes(self.draw, customers, s.parent_discount, self.strength, self.parent_logs)
        rest = np.maximum(s.parent_tables - np.maximum(self.parent_tables, 1), 0)
        self.parent_tables = tables = dishes.seat(np.minimum(customers, 1).astype(np.float64), rest, even, PARENT_STEPS)
        pull = (self.strength + s.parent_discount * s.parent_tables) * even
        self.chance = (np.maximum(customers - s.parent_discount * tables, 0) + pull) / (self.strength + everyone)

    def sweep(self) -> None:
        """Seat all customers of each pair again, given the tables of others, then the parent's."""
        at = self.several
        old = self.tables[at]
        rest = np.maximum(self.context_tables[self.context[at]] - old, 0)
        self.tables[at] = self.dishes.seat(old, rest, self.chance[self.word[at]])
        np.add.at(self.context_tables, self.context[at], self.tables[at] - old)
        self._parent()

    def probabilities(self) -> np.ndarray:
        """Of each pair's word behind its context."""
        s = self.sums
        below = self.strength + s.customers[self.context]
        own = np.maximum(self.customers - s.discount * self.tables, 0)
        return (own + (self.strength + s.discount * s.tables[self.context]) * self.chance[self.word]) / below


def seated(buckets: DataFrame, sums: Totals, strength: float, sweeps: int = BURN_IN) -> Totals:
    """`sums` with the tables that context restaurants and the parent have after `sweeps`."""

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _each(batches):
            for bucket, data in zip(batch["bucket"].to_pylist(), batch["pairs"]):
                found = Seating(bucket, data.as_buffer(), sums, strength)
                for _ in range(sweeps):
                    found.sweep()
                tables = np.bincount(found.context, found.tables, _CONTEXTS).astype(np.int64)
                held = np.flatnonzero(tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*held.tolist(), -1, -2 - bucket]),
                     pa.array([*tables[held].tolist(), int(found.parent_tables.sum()) * found.reports, int(found.tables.sum())])],
                    names=["context", "tables"],
                )

    got = (
        buckets.where("bucket >= 0").select("bucket", "pairs").mapInArrow(seat, "context long, tables long")
        .groupBy("context").agg(F.sum("tables").alias("tables")).toArrow()
    )
    context, t = got["context"].to_numpy(), got["tables"].to_numpy()
    tables = np.zeros(_CONTEXTS)
    tables[context[context >= 0]] = t[context >= 0]
    shares = dict(zip((-2 - context[context < -1]).tolist(), t[context < -1].tolist()))
    pieces = {b: (n, shares.get(b, 0)) for b, (n, _) in (sums.pieces or {}).items()}
    return Totals(sums.customers, tables, sums.tokens, sums.words, float(t[context == -1].sum()), sums.discount,
                  sums.parent_discount, shares, sums.hot, pieces)


def score_texts(
    docs: DataFrame, strength: float = STRENGTH, burn_in: int = BURN_IN, samples: int = SAMPLES, folds: int = FOLDS
) -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of each row.

    Rows whose crc32 of the id as text leaves 0 modulo `folds` are held out. A null
    text is empty: one end. A null id counts as the empty text. `base_score` is the
    log10 probability under single words with 0.1 added to counts; `score` that of
    the averaged seatings. Without any fitted row all words are unknown. Draws are seeded
    by bucket: a run with as many shuffle partitions gives the same scores, one with
    others the scores of other draws.
    """
    count = max(BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (remainder(F.col("doc_id"), folds) != 0).alias("fitted"),
    )
    hot = hot_words(rows, count)
    buckets = written(gather(rows, count, hot), "buckets")
    sums = totals(buckets, hot)
    for _ in range(burn_in):  # each with the totals of the one before
        sums = seated(buckets, sums, strength, 1)
    smooth = np.log10(sums.tokens + 0.1 * (sums.words + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _each(batches):
            for bucket, data, owners in zip(batch["bucket"].to_pylist(), batch["pairs"], batch["owners"]):
                found = Seating(bucket, data.as_buffer(), sums, strength)
                chance = np.zeros(len(found.word))
                for k in range(burn_in + samples):
                    found.sweep()
                    if k >= burn_in:
                        chance += found.probabilities() / samples
                counts = (np.bincount(found.word, found.customers, found.words) + found.tokens_elsewhere)[found.word]
                base = np.log10(counts + 0.1) - smooth
                head = np.frombuffer(owners.as_buffer(), "<i8", 3)
                wide = "<u2" if head[1] == head[2] else "<u4"
                known, place, row = _unpack(owners.as_buffer(), "<i8", wide, "<u2")
                slot = place.astype(np.int64) << 16 | row
                values = (np.log10(chance), base, (counts > 0).astype(np.int64))
                token = np.repeat(np.arange(len(found.word), dtype=np.int32), found.every)
                del found, chance, base, counts
                order = np.argsort(slot, kind="stable")
                slot, token = slot[order], token[order]
                firsts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                if not len(slot):
                    continue
                values = [np.add.reduceat(x[token], firsts) for x in values]
                texts = slot[firsts]
                bounds = np.searchsorted(texts >> 16, np.arange(len(known) + 1)).tolist()
                blobs = [
                    _pack((texts[a:b] & 0xFFFF).astype("<u2"), values[0][a:b].astype("<f4"), values[1][a:b], values[2][a:b].astype("<u4"))
                    for a, b in zip(bounds, bounds[1:])
                ]
                yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(blobs, pa.binary())], names=["slice", "data"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(-batch["bucket"].to_numpy()), batch["pairs"]], names=["slice", "data"])

    def add(table):
        ids = None
        parts = []
        for kind, blob in zip(table["ids"].to_pylist(), table["data"].to_pylist()):
            if kind:
                ids, present, tokens = _unpack(blob, "<i8", "u1", "<i8")
            else:
                parts.append(_unpack(blob, "<u2", "<f4", "<f8", "<u4"))
        size = len(ids)
        parts.sort(key=lambda p: p[0].tobytes() + p[2].tobytes())  # sums in one order, however they came
        texts = np.concatenate([p[0] for p in parts]).astype(np.int64)
        score, base, known = (np.bincount(texts, np.concatenate([p[k] for p in parts]).astype(float), size) for k in (1, 2, 3))
        valid = np.unpackbits(present, count=size).astype(bool)
        return pa.table(
            [pa.array(ids, mask=~valid), pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    parts = buckets.where("bucket >= 0").mapInArrow(score, "slice long, data binary").withColumn("ids", F.lit(False))
    lists = buckets.where("bucket < 0").mapInArrow(listed, "slice long, data binary").withColumn("ids", F.lit(True))
    sums_ = parts.unionByName(lists).groupBy("slice").applyInArrow(
        add, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return sums_.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(sums.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
