"""How far the word use of each source departs from the other sources of its language.

Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII. Tasks
count them without an object per term: a term of up to 8 bytes is one uint64, one
of up to 16 bytes two, first byte highest, so numbers sort as bytes do; both kinds
are radix-sorted, 16 bits a pass, and their runs counted. Longer terms are sorted
as bytes, in buckets of like length. A row of counts then has two words and, for
long terms only, the bytes behind the first 16, so one form names all terms and
its order is their UTF-8 order.

Counts of a term meet by language and term, which is where its documents are
counted and it is kept or dropped. Sums over kept terms of a language are taken
in buckets of terms, as many as its rows ask for, and in blocks of sources: a
task holds a matrix of some terms by all sources of the language, and gives one
number for each pair of sources.

Shares are whole numbers, and all arithmetic is exact: a share of `count + 1` in
`total` is divided out three digits at a time, so no product leaves 64 bits up to
9 * 10^15 occurrences.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import give_back, slices, words_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_DOCUMENTS = 3
RANKS = 200  # of part `term`
SCALE = 1_000_000_000
CHUNK = 4_000_000  # occurrences that are sorted together
BUCKET_ROWS = 200_000
BLOCK_SOURCES = 512
CELLS = 1 << 20  # of a matrix of terms and sources

_APART = np.ones(256, dtype=bool)
_APART[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SIGN = np.uint64(1 << 63)
_COUNTS = "lang string, source string, first long, second long, rest binary, n long, docs long"
_TERM = ("first", "second", "rest")


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by unsigned columns, the first one above the others; 16 bits a pass."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        digits = column.view("<u2").reshape(len(column), column.itemsize // 2)
        for k in range(digits.shape[1]):
            digit = np.ascontiguousarray(digits[:, k])
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_counts(columns: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of equal sorted columns begin, how long they are and how many different `rows` they hold."""
    opens = np.zeros(len(rows), dtype=bool)
    opens[:1] = True
    for column in columns:
        opens[1:] |= column[1:] != column[:-1]
    other = opens.copy()
    other[1:] |= rows[1:] != rows[:-1]
    begins = np.flatnonzero(opens)
    lengths = np.diff(np.append(begins, len(rows)))
    return begins, lengths, np.add.reduceat(other, begins, dtype=np.int64) if len(begins) else lengths


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start on, the first one highest, zeros behind."""
    eight = np.ndarray((max(len(data) - 7, 0),), ">u8", data, 0, (1,))
    shift = (8 * (8 - np.minimum(lengths, 8))).astype(np.uint64)
    return eight[starts].astype(np.uint64) >> shift << shift


class Counter:
    """Occurrences of terms by group, until they are counted."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.documents = 0
        self.clear()

    def clear(self) -> None:
        # One word, two words: group, row and words of each occurrence. Long terms: lists by like length.
        self.short: list[list[tuple[np.ndarray, ...]]] = [[], []]
        self.long: dict[int, list[tuple[bytes, int, int]]] = {}
        self.held = 0

    def add(self, part: pa.RecordBatch) -> None:
        words = words_of(part["text"], True, _APART)
        names = list(zip(part["lang"].to_pylist(), part["source"].to_pylist()))
        codes = np.array([self.groups.setdefault(name, len(self.groups)) for name in names], dtype=np.uint32)
        rows = words.rows
        group, row = codes[rows], (rows + self.documents).astype(np.uint32)
        self.documents += part.num_rows
        lengths = words.ends - words.starts
        for at, several in enumerate((lengths <= 8, (lengths > 8) & (lengths <= 16))):
            starts, left = words.starts[several], lengths[several]
            columns = [_packed(words.data, starts, left)]
            if at:
                columns.append(_packed(words.data, starts + 8, left - 8))
            self.short[at].append((group[several], row[several], *columns))
        for k in np.flatnonzero(lengths > 16).tolist():
            term = words.data[words.starts[k] : words.ends[k]].tobytes()
            self.long.setdefault(len(term).bit_length(), []).append((term, int(group[k]), int(row[k])))
        self.held += len(rows)

    def counted(self) -> Iterator[pa.RecordBatch]:
        named = list(self.groups)
        langs = pa.array([lang for lang, _ in named], pa.string())
        sources = pa.array([source for _, source in named], pa.string())

        def batch(group, first, second, rest, n, docs) -> pa.RecordBatch:
            group = pa.array(group.astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [langs.take(group), sources.take(group), pa.array((first ^ _SIGN).view(np.int64)),
                 pa.array((second ^ _SIGN).view(np.int64)), rest, pa.array(n), pa.array(docs)],
                names=["lang", "source", "first", "second", "rest", "n", "docs"],
            )

        for parts in self.short:
            if not sum(len(p[0]) for p in parts):
                continue
            group, row, *words = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            order = radix_order([group, *words])  # stable, so rows of a run stay in order
            group, words = group[order], [w[order] for w in words]
            begins, n, docs = run_counts([group, *words], row[order])
            first = words[0][begins]
            second = words[1][begins] if len(words) > 1 else np.zeros_like(first)
            for at in range(0, len(begins), 100_000):
                cut = slice(at, at + 100_000)
                yield batch(group[begins[cut]], first[cut], second[cut], pa.nulls(len(n[cut]), pa.binary()), n[cut], docs[cut])
        for bucket in self.long.values():
            bucket.sort()
            terms = [t for t, *_ in bucket]
            group, row = (np.array([b[k] for b in bucket], dtype=np.int64) for k in (1, 2))
            same = np.array([a == b for a, b in zip(terms, terms[1:])], dtype=bool)
            number = np.concatenate([[0], np.cumsum(~same)])
            begins, n, docs = run_counts([number, group], row)
            heads = np.frombuffer(b"".join(terms[k][:16] for k in begins), ">u8").astype(np.uint64).reshape(-1, 2)
            rest = pa.array([terms[k][16:] for k in begins], pa.binary())
            yield batch(group[begins], heads[:, 0].copy(), heads[:, 1].copy(), rest, n, docs)
        self.clear()


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences (`n`) and documents (`docs`) of terms by `lang` and `source`, in several rows each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for part in slices(batches, "text"):
            counter.add(part)
            if counter.held >= CHUNK:
                yield from counter.counted()
        yield from counter.counted()
        give_back()

    return docs.mapInArrow(count, _COUNTS)


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """Rows of terms that `least` documents of their language hold, with `lang_n`, and `opens` on one row of each."""
    term = Window.partitionBy("lang", *_TERM)
    # One exchange: rows of a term stay together for the sums by source as for those of the language.
    return (
        counts.repartition("lang", *_TERM).groupBy("lang", *_TERM, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("in_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
        .withColumn("opens", F.row_number().over(term.orderBy("source")) == 1)
        .where(F.col("in_docs") >= least).drop("docs", "in_docs")
    )


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), three digits at a time."""
    div = lambda a: F.call_function("div", a, total)
    rest = count + 1
    out = div(rest)
    for _ in range(3):
        rest = (rest % total) * 1000
        out = out * 1000 + div(rest)
    return out + 1


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """As `share`, for arrays."""
    out, rest = np.divmod(counts + 1, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + more
    return out + 1


def _pair_sums(key: tuple, terms: pa.Table, totals: pa.Table) -> pa.Table:
    """Sums over the given terms of one language, for a block of its sources against all."""
    lang, block = key[0].as_py(), key[2].as_py()
    names = totals["source"].to_pylist()
    place = {name: k for k, name in enumerate(names)}
    own = np.flatnonzero(totals["block"].to_numpy() == block)
    total = totals["total"].to_numpy()
    rest = terms["rest"].combine_chunks().dictionary_encode()
    rest = pc.fill_null(rest.indices, -1).to_numpy(zero_copy_only=False)
    columns = [terms["first"].to_numpy(), terms["second"].to_numpy(), rest]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    source = np.array([place[name] for name in terms["source"].to_pylist()], dtype=np.int64)[order]
    n = terms["n"].to_numpy()[order]
    opens = np.zeros(len(order), dtype=bool)
    opens[:1] = True
    for c in columns:
        opens[1:] |= c[1:] != c[:-1]
    term = np.cumsum(opens) - 1
    sums = np.zeros((len(own), len(names)), dtype=np.int64)
    step = max(1, CELLS // max(len(names), 1))
    for at in range(0, int(term[-1]) + 1 if len(term) else 0, step):
        low, high = np.searchsorted(term, [at, at + step])
        counts = np.zeros((min(step, int(term[-1]) + 1 - at), len(names)), dtype=np.int64)
        counts[term[low:high] - at, source[low:high]] = n[low:high]
        q = shares(counts, total)
        for k, s in enumerate(own):
            apart = q[:, s : s + 1] - q
            sums[k] += (apart * apart // q).sum(axis=0)
    a, b = np.repeat(own, len(names)), np.tile(np.arange(len(names)), len(own))
    other = a != b
    listed = pa.array(names, pa.string())
    return pa.table({
        "lang": pa.array([lang] * int(other.sum()), pa.string()), "source": listed.take(pa.array(a[other])),
        "item": listed.take(pa.array(b[other])), "value": sums.ravel()[other],
    })


def _text(first: Column, second: Column, rest: Column) -> Column:
    """The term of two words and the bytes behind them."""
    flip = lambda c: F.unhex(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))))
    empty = F.lit(b"")
    whole = F.concat(flip(first), F.when(second == F.lit(-(1 << 63)), empty).otherwise(flip(second)), F.coalesce(rest, empty))
    return F.replace(F.decode(whole, "UTF-8"), F.lit("\0"), F.lit(""))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank` of each group of language and source.

    Part `pair` has each other source of the language with the divergence of the group
    from it, summed over the language's terms; part `term` the terms the group uses more
    than its language, `ranks` at most. Null text, lang and source count as empty; rows
    that repeat are documents of their own. A group without terms has pairs; a language
    without kept terms has pairs of value 0. No documents, no rows. Other columns are not
    read, whatever their names.
    """
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = written(kept_terms(term_counts(given), least), "kept-terms")
    groups = given.select("lang", "source").distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.sum(F.col("opens").cast("long")).alias("terms"), F.count(F.lit(1)).alias("held")
    )
    sized = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    totals = written(
        sized.select(
            "lang", "source", (F.coalesce("n", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("total"),
            (F.col("lang_total") + F.col("terms")).alias("lang_total"),
            F.ceil(F.coalesce("held", F.lit(0)) / BUCKET_ROWS).cast("int").alias("buckets"),
            F.floor(number / BLOCK_SOURCES).cast("int").alias("block"),
        ), "group-totals",
    )
    return _by_term(kept, totals, ranks).unionByName(_by_pair(kept, totals))


def _by_term(kept: DataFrame, totals: DataFrame, ranks: int) -> DataFrame:
    p, q = share(F.col("n"), F.col("total")), share(F.col("lang_n"), F.col("lang_total"))
    valued = (
        kept.join(totals.select("lang", "source", "total", "lang_total"), ["lang", "source"])
        .select("lang", "source", *_TERM, p.alias("p"), q.alias("q")).where("p > q")
        .withColumn("value", F.expr("(p - q) * (p - q) div q"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "first", "second", F.asc_nulls_first("rest"))
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).select(
        "lang", "source", F.lit("term").alias("part"), _text(*[F.col(c) for c in _TERM]).alias("item"), "value", "rank"
    )


def _by_pair(kept: DataFrame, totals: DataFrame) -> DataFrame:
    blocks = totals.groupBy("lang").agg(F.max("buckets").alias("buckets"), F.max("block").alias("last"))
    bucket = F.pmod(F.xxhash64(*_TERM), F.col("buckets")).cast("int")
    asked = kept.select("lang", "source", *_TERM, "n").join(blocks, "lang").select(
        "lang", "source", *_TERM, "n", bucket.alias("bucket"), F.explode(F.sequence(F.lit(0), "last")).alias("part")
    )
    sides = totals.join(blocks.select("lang", "last"), "lang").where("buckets > 0").select(
        "lang", "source", "total", "block",
        F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.col("last"),
    ).select("lang", "source", "total", "block", "bucket", F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    sums = (
        asked.groupBy("lang", "bucket", "part").cogroup(sides.groupBy("lang", "bucket", "part"))
        .applyInArrow(_pair_sums, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    pairs = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    ).withColumn("rank", F.row_number().over(order))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
occurring AS (
  SELECT row, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM occurring GROUP BY ALL HAVING count(DISTINCT row) >= 3),
counted AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occurring o JOIN kept k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source != a.source GROUP BY ALL),
valued AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source != a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM valued)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
