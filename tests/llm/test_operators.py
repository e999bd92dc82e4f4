"""Each operator against a plain version, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_words import words
from quayside.llm import (
    fm_index,
    line_runs,
    metric_tree,
    mixing,
    ngram_join,
    pitman_yor,
    simhash_benchmark,
    subword_quality,
    token_records,
    toxicity_crf,
)
from quayside.session import work_dir


def test_token_records(spark, corpus, frame, clashing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_records.VOCABULARY)
    rows = [*corpus(), (3, corpus()[3][1], "en", "s3", 1), (None, "no id", "en", "s", 5), (-4, "<|endoftext|> a  b", "en", "s", 3)]
    docs = clashing(frame(rows), "file", "n_tokens", "start")
    path = work_dir(spark, "records-test")
    got = token_records.token_digest(docs, path).orderBy("start").collect()
    ids = sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in rows)
    assert [r.doc_id for r in got] == [i if known else None for known, i, _ in ids]
    want = Counter()
    for row in rows:
        encoded = [*library.encode(row[1] or "", add_special_tokens=False).ids, 0]
        want[row[0], len(encoded), zlib.crc32(struct.pack(f"<{len(encoded)}I", *encoded))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    # In any other order the same records; a changed byte is noticed.
    index = token_records.read_index(spark, path)
    mixed = token_records.read_records(index, path, seed=3).select("doc_id", F.crc32("ids").alias("c"))
    assert Counter((r.doc_id, r.c) for r in mixed.collect()) == Counter({(k[0], k[2]): v for k, v in want.items()})
    one = index.where("doc_id = 0").first()
    file = f"{path.removeprefix('file://')}/{one.file}"
    with open(file, "r+b") as f:
        f.seek(one.offset + 14)
        byte = f.read(1)
        f.seek(one.offset + 14)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        token_records.read_records(index, path).count()
    assert token_records.token_digest(frame([])).count() == 0


def test_ids_are_those_of_the_library():
    """Texts of white space of all kinds, names of special tokens, parts of them, and characters of several bytes."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_records.VOCABULARY)
    rng = random.Random(11)
    pieces = [" ", " ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x00", "\x85", "\xa0", "\u1680", "\u2003", "\u200b", "\u2028", "\u202f", "\u205f",
              "\u3000", "\u2019", "a", "the", "don't", "42", "é", "日本", "😀", "<|endoftext|>", "<|endo", "text|>", "'s", "!?"]
    texts = ["a <|endoftext|> b", "x\xa0 y \xa0z", " <|endoftext|>", *["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(20_000)]]
    encoder = token_records.Encoder(token_records.VOCABULARY)
    for at in range(0, len(texts), 4000):
        part = texts[at : at + 4000]
        flat, counts = encoder.encode(pa.array(part))
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert flat.tolist() == [i for w in want for i in w]


def test_checksums():
    # The check value of CRC-32C.
    value = 0xE3069283
    masked = (((value >> 15) | (value << 17)) + token_records.MASK_DELTA) & 0xFFFFFFFF
    assert int(token_records.masked_checksums(np.frombuffer(b"123456789", np.uint8), np.array([0, 9]))[0]) == masked


def test_language_model(spark, corpus, frame, clashing):
    rows = [*corpus(2, 80), (5, "again here", "en", "s", 3), (None, "no id here", "en", "s", 3)]
    got = pitman_yor.score_texts(clashing(frame(rows), "score", "bucket", "fitted")).collect()
    seen = Counter()
    for i, text, *_ in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            seen.update([*words(text), None])
    n, v = sum(seen.values()), len(seen)
    want = Counter()
    for i, text, *_ in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[i, zlib.crc32(str("" if i is None else i).encode()) % 10 == 0, len(tokens), sum(seen[w] > 0 for w in tokens), round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) and r.train_tokens == n for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = pitman_yor.score_texts(frame(rows)).collect()
    by = lambda rs: sorted((r.doc_id or -1, r.n_known, round(r.score, 3)) for r in rs)
    assert by(again) == by(got)
    assert pitman_yor.score_texts(frame([])).count() == 0


def test_frequent_words_are_split_by_their_contexts(spark, frame, monkeypatch):
    """Words with buckets of their own count and score as they do without."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join("the" if rng.random() < 0.4 else f"w{rng.integers(60)}" for _ in range(60)), "en", "s", 1) for k in range(120)]
    docs = frame(rows).select("doc_id", "text", F.lit(True).alias("fitted"))
    hot = pitman_yor.hot_words(docs, 20)
    # Of 20 buckets' worth of tokens the word has eight, and the end of a text none.
    assert len(hot.words) == 1 and hot.first[0] == 20 and 7 <= len(hot.siblings(20)) <= 9 and not hot.siblings(19)
    buckets = pitman_yor.gather(docs, 20, hot).where("bucket >= 20").collect()
    tokens = [int(pitman_yor._pairs(bytes(b.pairs))[3].sum()) for b in buckets]
    assert sum(tokens) == sum(r[1].split().count("the") for r in rows) and max(tokens) < 0.6 * sum(tokens)
    monkeypatch.setattr(pitman_yor, "BUCKETS", 20)
    split = {r.doc_id: r for r in pitman_yor.score_texts(frame(rows)).collect()}
    monkeypatch.setattr(pitman_yor, "hot_words", lambda docs, buckets: pitman_yor.Hot(np.zeros(0, np.uint64), np.array([buckets])))
    whole = {r.doc_id: r for r in pitman_yor.score_texts(frame(rows)).collect()}
    for i, r in split.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (whole[i].n_tokens, whole[i].n_known, whole[i].train_tokens)
        assert r.base_score == pytest.approx(whole[i].base_score)
    # Other draws of the same model.
    assert sum(r.score for r in split.values()) == pytest.approx(sum(r.score for r in whole.values()), rel=0.01)


def test_model_is_a_distribution(spark):
    """Over all words and the unknown one, probabilities behind a context add up to one."""
    rows = [(k, "a b a c a b", "en", "s", 1) for k in range(1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(
        "doc_id", "text", F.lit(True).alias("fitted"))
    buckets = pitman_yor.gather(docs, 3).where("bucket >= 0").collect()
    table = spark.createDataFrame(buckets, "bucket long, pairs binary, owners binary")
    sums = pitman_yor.seated(table, pitman_yor.totals(table), 1.0)
    assert sums.tokens == 8 * 7 and sums.words == 4
    total, per_context = 0.0, defaultdict(float)
    for row in buckets:
        found = pitman_yor.Seating(row.bucket, bytes(row.pairs), sums, 1.0)
        assert (found.tables >= 1).all() and (found.tables <= found.customers).all()
        for _ in range(3):
            found.sweep()
            assert (found.sizes >= 0).all() and found.sizes.sum() == found.customers[found.customers > 1].sum()
            for k, pair in enumerate(found.several):
                a, n = found.begins[k], found.customers[pair]
                assert (found.sizes[a : a + n] > 0).sum() == found.tables[pair]
        total += found.chance.sum()
    assert 0.8 < total < 1.05  # what is missing is the unknown word's


def test_every_customer_is_seated_again():
    """Tables of pairs follow their exact distribution, however many customers a pair has."""
    for n, d, rest, chance in [(3, 0.5, 10, 0.1), (90, 0.7, 40, 0.05), (600, 0.3, 100, 0.05), (2000, 0.6, 500, 0.02)]:
        front = np.cumsum(np.log(np.append(1 / chance, 1 + d * (rest + np.arange(1, n))) * chance))
        weights = pitman_yor.stirling(n, d)[n, 1:] + front
        weights = np.exp(weights - weights.max())
        mean = (weights * np.arange(1, n + 1)).sum() / weights.sum()
        dishes = pitman_yor.Dishes(np.random.default_rng(1), np.full(500, n), d, 1.0)
        tables, got = np.ones(500), []
        for _ in range(12):
            tables = dishes.seat(tables, np.full(500, float(rest)), np.full(500, chance))
            got.append(tables.mean())
        assert np.mean(got[4:]) == pytest.approx(mean, rel=0.03)
    # A pair of many customers forgets its tables within the sweeps of a run.
    data = pitman_yor._pack(np.array([7, 9], "<u8"), np.array([1, 1], "<u4"), np.array([3, 3], "<u2"),
                            np.array([5000, 4000], "<u4"), np.array([5000, 4000], "<u4"))
    customers, tables = np.zeros(1 << pitman_yor.CONTEXT_BITS), np.zeros(1 << pitman_yor.CONTEXT_BITS)
    customers[3], tables[3] = 9000, 2
    found = pitman_yor.Seating(1, data, pitman_yor.Totals(customers, tables, 9000, 2, 2.0, 0.5, 0.5), 1.0)
    drawn = []
    for _ in range(200):
        found.sweep()
        drawn.append(found.tables.copy())
    changed = (np.diff(np.array(drawn), axis=0) != 0).mean()
    assert changed > 0.2 and np.mean(drawn) < 8


def lines_by_brute_force(rows, least=1):
    first, out = {}, []
    named = sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None})
    for i, text in named:
        lines = text.split("\n")
        gone = [False] * len(lines)
        for size in {least, 2}:
            for k in range(len(lines) - size + 1):
                window = tuple(lines[k : k + size])
                if size == 1 and not words(window[0]):
                    continue  # a line without words is no run of its own
                if window in first:
                    gone[k : k + size] = [True] * size
                else:
                    first[window] = (i, k)
        out.append((i, len(lines), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(lines, gone) if not g).encode()).hexdigest()))
    return out


def test_line_runs(frame, corpus, clashing):
    rows = corpus(3, 30)
    rows += [(100 + k, "\n".join(["head", *"abcdefgh"[k : k + 4], "a", "b"]), "en", "s", 1) for k in range(5)]
    rows += [(200, "a\na\na\na", "en", "s", 1), (201, "a\n\n\na\n", "en", "s", 1)]
    got = line_runs.line_dedup(clashing(frame(rows), "pos", "n_lines", "name")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    want = [*lines_by_brute_force(rows), *[(r[0], 0, 0, empty) for r in rows if r[1] is None]]
    assert sorted(tuple(r) for r in got) == sorted(want)
    # Rows that repeat get one answer; a null id loses nothing and costs nothing.
    odd = line_runs.line_dedup(frame([(1, "a\nb", "", "", 0), (1, "a\nb", "", "", 0), (None, "a\nb", "", "", 0), (2, "a\nb", "", "", 0)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in odd) == [(0, 0), (1, 0), (1, 0), (2, 2)]
    assert line_runs.line_dedup(frame([])).count() == 0


def test_lines_alone(frame):
    """A copied line goes by itself if it holds a word; blank lines go within longer runs only."""
    one = "a line of its own"
    rows = [(1, one, "", "", 0), (2, one, "", "", 0), (3, f"x\n\n{one}\n\ny\n \nz", "", "", 0), (4, "p\n\nq\n \nr", "", "", 0), (5, "k\n\ny", "", "", 0)]
    got = line_runs.line_dedup(frame(rows)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in got) == [(1, 1, 0), (2, 1, 1), (3, 7, 1), (4, 5, 0), (5, 3, 2)]


def test_long_texts_of_copied_lines(frame):
    """The cut of a text takes time in proportion to its lines."""
    import time

    rows = [(1, "\n".join(f"line {k}" for k in range(30_000)), "", "", 0), (2, "\n".join(f"line {k}" if k % 3 else f"new {k}" for k in range(30_000)), "", "", 0)]
    began = time.monotonic()
    got = {r.doc_id: r.n_removed for r in line_runs.line_dedup(frame(rows)).collect()}
    assert got == {1: 0, 2: 20_000} and time.monotonic() - began < 60


def test_line_runs_are_maximal(frame):
    docs = frame([(1, "a\nb\nc\nd\ne", "", "", 0), (2, "x\nb\nc\nd\ny\na\nb", "", "", 0)]).withColumn("text_key", F.xxhash64("text"))
    runs = line_runs.repeated_runs(docs).select("doc_id", "begin", "end", "from_id", "from_begin").collect()
    assert sorted(tuple(r) for r in runs) == [(2, 1, 4, 1, 1), (2, 5, 7, 1, 0)]


def test_mixing(spark, corpus, frame, clashing, tmp_path):
    import duckdb

    rows = [*corpus(4, 120), (7, "repeated row", "en", "s3", 1), (None, "no id", "en", "s0", 1)]
    docs = clashing(frame(rows), "size", "target", "rate", "row", "own", "copies", "_source", "_size", "_copies", "_rate")
    got = mixing.mixture_report(docs).collect()
    frame(rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()
    near = lambda rs: sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in rs)
    assert near(map(tuple, got)) == near(want)
    assert all(r.taken <= 3 * r.size for r in got) and all(r.target <= 3 * r.source_size + 1e-9 for r in got)
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns
    assert {r for r in taken.select("size", "copies", "_size", "_copies").distinct().collect()} == {("given",) * 4}
    assert taken.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert mixing.mixture_report(frame([])).count() == 0


def test_targets_fill_up(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    shares = {r.source: r for r in mixing.source_targets(sized).collect()}
    # a (5) and null (5) stop at three times their sizes, b (2) and c (1) share what is left.
    assert shares["a"].target == 30 and shares[None].target == 15
    assert shares["b"].target == pytest.approx(1970 * 2 / 3) and shares["c"].target == pytest.approx(1970 / 3)


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(700):
        parts = [vocabulary[i] for i in rng.integers(0, 300, rng.integers(5, 60))]
        toxic, poor = int(k % 6 == 0), int(k % 5 == 0)
        if toxic:
            for word in rng.choice(["idiot", "clown,", "Moron."], 3):
                parts.insert(int(rng.integers(len(parts))), str(word))
        if poor:
            parts = [f"{p}%%%" for p in parts]
        rows.append((k, " ".join(parts), "en", "s", 1))
        labels.append((k, 1 - poor, toxic))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity(spark, frame, labelled, clashing):
    rows, labels = labelled
    odd = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "you IDIOT you", "en", "s", 0), (9002, "word " * 50000, "en", "s", 0)]
    docs = clashing(frame([*rows, *odd]), "score", "label")
    twice = toxicity_crf.score_toxicity(clashing(frame(odd), "_score", "_SPANS"), toxicity_crf.train_field(frame([]), spark.createDataFrame(labels, LABELS)))
    assert twice.columns[-4:] == ["_score", "_SPANS", "__score", "__spans"] and {r["_score"] for r in twice.collect()} == {"given"}
    given = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1), (5, 1, 0)], LABELS)
    scored = toxicity_crf.score_toxicity(docs, toxicity_crf.train_field(docs, given)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([(r["_score"] >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r["_score"] <= 1 for r in scored)
    by = {r.doc_id: r for r in scored}
    assert by[9000]["_score"] == by[9001]["_score"] < 0.5 and by[9000]["_spans"] == []
    span = by[None]["_spans"][0]
    assert by[None].text[span.begin : span.end] == "IDIOT"
    assert by[0].score == "given"
    assert toxicity_crf.score_toxicity(frame([]), toxicity_crf.train_field(frame([]), given)).count() == 0


def test_messages_against_enumeration():
    rng = np.random.default_rng(1)
    energies, states = rng.normal(size=7), rng.normal(size=(2, 2))
    head = np.array([True, False, False, True, True, False, False])
    alpha, beta = toxicity_crf.messages(energies, head, states)
    got = alpha[1] * beta[1] / (alpha * beta).sum(axis=0)
    weights, ones = 0.0, np.zeros(7)
    for code in range(128):
        y = [(code >> k) & 1 for k in range(7)]
        score = sum(energies[k] * y[k] + (states[0, y[k]] if head[k] else states[y[k - 1], y[k]]) for k in range(7))
        weights += np.exp(score)
        ones += np.exp(score) * np.array(y)
    assert np.allclose(got, ones / weights)


def test_quality(spark, frame, labelled, clashing):
    rows, labels = labelled
    docs = clashing(frame([*rows, (9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "w1 w2", "en", "s", 0)]), "score")
    given = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1)], LABELS)
    scored = subword_quality.score_quality(docs, subword_quality.train_subwords(docs, given)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r["_score"] >= 0.3) == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r["_score"] for r in scored}
    assert by[9000] == by[9001] and 0 <= by[9000] <= 1
    assert subword_quality.score_quality(frame([]), subword_quality.train_subwords(frame([]), given)).count() == 0


def groups_by_brute_force(rows):
    sets = {}
    for i, text, *_ in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join(frame, corpus, clashing, seed):
    rows = corpus(seed, 120)
    rows += [(300 + k, "a b c", "", "", 0) for k in range(2)] + [(310, "a b", "", "", 0)]
    docs = clashing(frame(rows), "token", "component_id", "n")
    got = ngram_join.similar_documents(docs).collect()
    assert sorted(tuple(r) for r in got) == groups_by_brute_force(rows)


def test_ngram_join_of_many_near_copies(frame):
    """A large group of near copies, each with a word changed, and repeated rows."""
    base = [f"t{k}" for k in range(80)]
    rows = [(k, " ".join(["z" + str(k) if j == k % 80 else w for j, w in enumerate(base)]), "", "", 0) for k in range(200)]
    rows += [rows[0], (None, rows[3][1], "", "", 0)]
    got = ngram_join.similar_documents(frame(rows)).collect()
    want = dict((i, c) for i, _, c in groups_by_brute_force(rows[:200]))
    assert len(got) == 202
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert ngram_join.similar_documents(frame([])).count() == 0


def test_search(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rng.normal(size=8)], 1) for k in range(400)]
    rows += [(400, rows[3][1], 1), (401, rows[3][1], 1), (420, [0.0] * 8, 1), (440, None, 1), (460, [1.0, None] + [0.0] * 6, 1),
             (480, [float("nan")] * 8, 1), (500, [float("inf")] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = metric_tree.top_scores(table.withColumn("score", F.lit(1)), shard_rows=100, query_rows=10)
    table.coalesce(1).write.parquet(str(tmp_path / "v"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    want = db.execute(f"SELECT query_id, rank, vec_id, score FROM ({metric_tree.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert metric_tree.top_scores(table.limit(0)).count() == 0
    assert metric_tree.top_scores(table.where("vec_id in (0, 1, 2)")).count() == 2
    # Vectors of several sizes meet their own size only; a small block holds one query.
    mixed = spark.createDataFrame([(k, [float(k)] * (2 + k % 2), 1) for k in range(0, 81)], table.schema)
    answers = metric_tree.top_scores(mixed, query_rows=1, shard_rows=30).where("query_id = 20 and rank <= 2").collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in answers) == [(1, 80, 2 * 64 * 80 * 64 * 20), (2, 78, 2 * 64 * 78 * 64 * 20)]


def test_each_row_goes_to_one_tree(spark, monkeypatch):
    """However many blocks of queries there are, trees are built once."""
    built, asked = [], []
    inner = metric_tree._ask
    monkeypatch.setattr(metric_tree, "_ask", lambda trees, *a: (built.append(trees), asked.append(a[0].num_rows), inner(trees, *a))[-1])
    table = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    assert metric_tree.top_scores(table, shard_rows=100, query_rows=5).count() == 400
    assert len(asked) == 4 and sum(asked) == 20 and len({id(t) for t in built}) == 1


def test_search_skips_distances():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 6)) * 40
    exact = np.floor((centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 6)))).astype(np.int64)
    lengths = (exact**2).sum(axis=1)
    points = np.concatenate([exact, np.sqrt(lengths.max() - lengths)[:, None]], axis=1)
    asked = exact[5]
    root = metric_tree.build(points, exact, np.arange(3000), 32)
    found, computed = metric_tree.search(root, float(lengths.max()), asked, 5, 10)
    scores = exact @ asked
    want = sorted(((int(s), -k) for k, s in enumerate(scores) if k != 5), reverse=True)[:10]
    assert found == [(s, -k) for s, k in want] and computed < 1500


def spans_by_brute_force(rows, size=50):
    first, tokens = {}, [(i, words(t, False)) for i, t, *_ in rows]
    for i, w in tokens:
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            first[window] = min(first.get(window, i), i)
    out = []
    for i, w in tokens:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowded", [2, 16_384])
def test_substring_dedup(frame, corpus, clashing, monkeypatch, crowded):
    monkeypatch.setattr(fm_index, "CROWDED", crowded)
    rows = [*corpus(5, 100), (3, "another text of the third", "en", "s", 1)]
    got = fm_index.substring_dedup(clashing(frame(rows), "begin", "n_words", "text_key")).collect()
    assert sorted(tuple(r) for r in got) == spans_by_brute_force(rows)
    assert sum(r.n_removed > 0 for r in got) > 10


def test_substring_dedup_of_odd_rows(frame):
    text = " ".join(f"v{k}" for k in range(60))
    rows = [(1, text, "", "", 0), (1, text, "", "", 0), (None, text, "", "", 0), (2, text, "", "", 0), (2, "other " + text, "", "", 0)]
    got = fm_index.substring_dedup(frame(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 60, 0), (1, 60, 0), (1, 60, 0), (2, 60, 60), (2, 61, 60)]
    assert fm_index.substring_dedup(frame([])).count() == 0


def test_backward_search():
    rng = np.random.default_rng(6)
    text = np.append(rng.integers(1, 6, 400), 0)
    index = fm_index.FmIndex(text, 5, 4)
    patterns = np.array([[a, b, c] for a in range(1, 6) for b in range(1, 6) for c in range(1, 6)])
    low, high = index.search(patterns)
    for pattern, a, b in zip(patterns, low, high):
        at = [k for k in range(398) if (text[k : k + 3] == pattern).all()]
        assert sorted(index.places[a:b].tolist()) == at


def test_matching_statistics():
    """Of streams that are in the text, partly in it, and not at all, cut off at ten."""
    rng = np.random.default_rng(9)
    text = np.append(rng.integers(1, 4, 600), 0)
    text[[100, 250, 400]] = 0
    index = fm_index.FmIndex(text, 6, 10)
    streams = [text[120:180].copy(), rng.integers(1, 5, 80), np.array([5, 6, 1, 2, -1, 2, 1, 3, 3]), np.array([6]), text[251:399].copy()]
    flat, sizes = np.concatenate(streams), np.array([len(x) for x in streams])
    lengths, lows, highs = index.statistics(flat, np.cumsum(sizes), sizes, 10)
    # What is behind a place in the text, up to its separator.
    parts = [text[k : k + 10].tolist() for k in range(len(text))]
    parts = [p[: p.index(0)] if 0 in p else p for p in parts]
    at = 0
    for stream in streams:
        for k in range(len(stream)):
            rest = stream[k : k + 10].tolist()
            want = max((n for n in range(len(rest) + 1) if n == 0 or any(p[:n] == rest[:n] for p in parts)), default=0)
            assert lengths[at] == want
            if want:
                places = sorted(j for j, p in enumerate(parts) if p[:want] == rest[:want])
                assert sorted(index.places[lows[at] : highs[at]].tolist()) == places
            at += 1


def passages_by_brute_force(rows, items):
    found = {}
    for i, text, *_ in rows:
        w = words(text)
        for item, body in items:
            x = words(body)
            k = min(5, len(x))
            if not x or i is None:
                continue
            theirs = Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1))
            for b in range(len(w) - len(x) + 1):
                part = w[b : b + len(x)]
                mine = Counter(tuple(part[a : a + k]) for a in range(len(part) - k + 1))
                both = sum((mine & theirs).values())
                similar = both / (sum(mine.values()) + sum(theirs.values()) - both)
                if 100 * similar >= 75 and similar > found.get((i, item), (0, 0))[0]:
                    found[i, item] = (similar, b)
    return sorted((i, item, b, round(s, 9)) for (i, item), (s, b) in found.items())


def test_decontamination(spark, frame, corpus, clashing):
    rows = corpus(8, 60)
    source = [words(r[1]) for r in rows[:40] if r[1] and len(words(r[1])) > 60]
    items = [(k, " ".join(w[10 : 10 + 20 + k])) for k, w in enumerate(source[:6])]
    items += [(20, " ".join([*source[0][5:30], "changed", *source[0][31:50]])), (21, "One two"), (22, ""), (23, None), (21, "One two"), (24, "word " * 12)]
    given = spark.createDataFrame(items, "item_id long, text string")
    docs = clashing(frame([*rows, (None, items[0][1], "", "", 0), rows[2]]), "begin", "similarity", "_found", "Text key")
    got = simhash_benchmark.contaminated(docs, given).collect()
    want = passages_by_brute_force([*rows], items)
    assert sorted((r.doc_id, r.item_id, r.begin, round(r.similarity, 9)) for r in got) == want and len(want) > 8
    left = simhash_benchmark.decontaminated(docs, given)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {r[0] for r in want} | {None}
    assert simhash_benchmark.contaminated(docs, given.limit(0)).count() == 0
    assert simhash_benchmark.contaminated(frame([]), given).count() == 0


def test_decontamination_of_short_documents(spark, frame):
    """A document that is an item without some of its words is found, though no window of it is as long."""
    body = [f"t{k}" for k in range(59)]
    items = spark.createDataFrame([(1, " ".join(body)), (2, "a b c d e f"), (3, "x y")], "item_id long, text string")
    rows = [(1, " ".join(body[:58])), (2, " ".join(body[1:])), (3, " ".join(body[:46])), (4, " ".join(body[:45])),
            (5, " ".join([*body[:30], "other", *body[31:57]])), (6, "a b c d e"), (7, "x"), (8, " ".join(["t0"] * 58)), (9, " ".join(body))]
    docs = frame([(i, t, "", "", 0) for i, t in rows])
    got = simhash_benchmark.contaminated(docs, items).collect()
    near = sorted((r.doc_id, r.item_id, r.begin, r.n_words, round(r.similarity, 4)) for r in got)
    assert near == [(1, 1, 0, 58, round(54 / 55, 4)), (2, 1, 0, 58, round(54 / 55, 4)), (3, 1, 0, 46, round(42 / 55, 4)),
                    (5, 1, 0, 57, round(48 / 60, 4)), (9, 1, 0, 59, 1.0)]
    assert sorted(r.doc_id for r in simhash_benchmark.decontaminated(docs, items).collect()) == [4, 6, 7, 8]


def test_decontamination_by_long_items(spark, frame):
    """An item of very many words inside a longer text, whole, with changes, and with repeated shingles."""
    body = [f"w{k % 7919}" for k in range(20_000)]
    changed = [("new" if k % 60 == 0 else w) for k, w in enumerate(body)]
    around = [f"z{k}" for k in range(20_000)]
    rows = [(1, " ".join([*around, *body, *around]), "", "", 0), (2, " ".join([*around[:777], *changed, *around]), "", "", 0),
            (3, " ".join([*around, *body[:9000], *around]), "", "", 0), (4, " ".join(["w1"] * 30_000), "", "", 0)]
    items = spark.createDataFrame([(1, " ".join(body)), (2, "some other item of ten words at the least here")], "item_id long, text string")
    got = simhash_benchmark.contaminated(frame(rows), items).collect()
    assert sorted((r.doc_id, r.item_id, r.begin, r.similarity > 0.99) for r in got) == [(1, 1, 20_000, True), (2, 1, 777, False)]


def test_sliding_overlaps_and_fingerprints(monkeypatch):
    rng = np.random.default_rng(8)
    codes, counts = rng.integers(-1, 5, 300).tolist(), [3, 1, 4, 2, 2]
    begins = [0, 1, 2, 5, 60, 61, 130, 200]
    want = [sum(min(codes[b : b + 40].count(c), n) for c, n in enumerate(counts)) for b in begins]
    assert simhash_benchmark.overlaps(codes, counts, begins, 40) == want
    shingles = rng.integers(0, 2**63, 500, dtype=np.uint64)
    starts = np.flatnonzero(rng.random(450) < 0.4)
    grid = shingles[starts[:, None] + np.arange(50)]
    monkeypatch.setattr(simhash_benchmark, "SPAN", 64)
    assert simhash_benchmark.window_fingerprints(shingles, starts, 50).tolist() == simhash_benchmark.fingerprints(grid).tolist()


def test_decontamination_by_items_without_an_id(spark, frame):
    one, two = (" ".join(f"{x}{k}" for k in range(20)) for x in "tu")
    items = spark.createDataFrame([(None, one), (None, two), (None, one), (5, two)], "item_id long, text string")
    docs = frame([(1, f"in front {one} behind", "", "", 0), (2, f"{two} {one}", "", "", 0), (3, "clean", "", "", 0)])
    got = simhash_benchmark.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id or 0, r.begin) for r in got) == [(1, 0, 2), (2, 0, 0), (2, 0, 20), (2, 5, 0)]
    assert [r.doc_id for r in simhash_benchmark.decontaminated(docs, items).collect()] == [3]
