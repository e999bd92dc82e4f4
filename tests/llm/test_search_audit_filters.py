"""Lexical search, source divergence and URL rules against plain versions, and on odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quayside.llm import lexical_search, source_divergence, url_rules

BENCHMARK = "item_id long, text string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def best_by_brute_force(rows, items, best=10):
    """Counter of (item_id, rank, doc_id, score)."""
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
    bags = [(row[0], Counter(terms(row[1]))) for row in rows]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in set(items):
        scored = []
        for doc, bag in bags:
            score = 0
            for t in set(terms(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + 90 * bag.total() * n_docs // n_terms
                score += w * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for k, (score, missing, doc) in enumerate(sorted(scored)[:best]):
            out[item, k + 1, None if missing else doc, -score] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_search(corpus, frame, spark, clashing, seed, monkeypatch):
    rows = [*corpus(seed, 200), (3, "w1 w2 once more", "en", "s", 3), (None, "w1 w2 without an id", "en", "s", 3)]
    texts = [r[1] for r in rows if r[1]]
    items = [(k, " ".join(texts[7 * k].split()[: 5 + 3 * k])) for k in range(12)]
    items += [(12, None), (13, ""), (14, "?! ..."), (15, "nowhere-found"), (16, "w1"), (16, "w2"), (17, "W1 w1 w1"), (17, "W1 w1 w1"),
              (18, "日本 ÜNÏ the"), (None, "of the"), (19, texts[9])]
    docs = clashing(frame(rows), "item", "rank", "score", "term", "ids")
    asked = clashing(spark.createDataFrame(items, BENCHMARK), "item", "term", "doc_id")
    want = best_by_brute_force(rows, items)
    found = lambda: Counter(tuple(r) for r in lexical_search.top_documents(docs, asked).collect())
    assert found() == want
    # Small shards, blocks and windows: the same rows.
    for name, value in [("SHARD_POSTINGS", 900), ("BLOCK_TERMS", 40), ("NEIGHBOURS", 4), ("WINDOW", 2), ("SHORT", 3)]:
        monkeypatch.setattr(lexical_search, name, value)
    assert found() == want
    monkeypatch.setattr(lexical_search, "SHORT", 10**9)  # every list is long
    assert found() == want
    monkeypatch.setattr(lexical_search, "SHORT", 0)  # and none
    assert found() == want


def test_search_of_ties_and_nothing(frame, spark):
    rows = [(k, "same words here", "en", "s", 1) for k in range(40, 0, -1)] + [(99, "other", "en", "s", 1)]
    items = [(1, "same other")]
    asked = spark.createDataFrame(items, BENCHMARK)
    got = lexical_search.top_documents(frame(rows), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == best_by_brute_force(rows, items)
    assert lexical_search.top_documents(frame([]), asked).count() == 0
    assert lexical_search.top_documents(frame(rows), spark.createDataFrame([], BENCHMARK)).count() == 0
    assert lexical_search.top_documents(frame([(1, None, "en", "s", 1)]), asked).count() == 0


def test_windows_skip_blocks(monkeypatch):
    """Blocks that cannot reach the threshold are not scored, and results stay."""
    rng = np.random.default_rng(3)
    n, lists = 5000, []
    places, often, held = [], [], []
    for k, p in enumerate((0.9, 0.5, 0.2, 0.01)):
        at = np.flatnonzero(rng.random(n) < p)
        places.append(at)
        often.append(rng.geometric(0.3, len(at)))
        held.append(len(at))
        lists.append(((5, 40, 300, 2500)[k], k))
    row = {"terms": np.arange(4), "held": np.array(held), "lengths": rng.integers(1, 400, n).astype("<u4").tobytes(),
           "places": np.concatenate(places).astype("<u4").tobytes(), "often": np.concatenate(often).astype("<u4").tobytes()}
    shard = lexical_search.Shard(row, n, 200 * n)
    seen = []
    inner = lexical_search._window
    monkeypatch.setattr(lexical_search, "_window", lambda s, b, blocks, *rest: (seen.extend(blocks), inner(s, b, blocks, *rest)))
    monkeypatch.setattr(lexical_search, "NEIGHBOURS", 8)
    shard = lexical_search.Shard(row, n, 200 * n)
    best = lexical_search.Best(np.arange(n), 10)
    lexical_search.search_shard(shard, best, lists)
    scores = np.zeros(n, np.int64)
    for weight, k in lists:
        at, worth = shard.entries(k)
        scores[at] += weight * worth
    want = np.lexsort((np.arange(n), -scores))[:10]
    assert best.places.tolist() == want.tolist() and best.scores.tolist() == scores[want].tolist()
    assert len(seen) < shard.blocks // 2


def audit_by_brute_force(rows, least=3, ranks=200):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(r[1]))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        held = Counter(t for x, _, terms in docs if x == lang for t in set(terms))
        kept = sorted((t for t in held if held[t] >= least), key=lambda t: t.encode())
        counts = defaultdict(Counter)
        for x, source, terms in docs:
            if x == lang:
                counts[source].update(t for t in terms if held[t] >= least)
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 1) // (c.total() + len(kept)) for t in kept}
        whole = share(sum(counts.values(), Counter()))
        own = {source: share(c) for source, c in counts.items()}
        for source, c in counts.items():
            pairs = [(-sum((own[source][t] - q[t]) ** 2 // q[t] for t in kept), other.encode()) for other, q in own.items() if other != source]
            for k, (value, other) in enumerate(sorted(pairs)):
                out.add((lang, source, "pair", other.decode(), -value, k + 1))
            terms = [(-((own[source][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in c if c[t] and own[source][t] > whole[t]]
            for k, (value, t) in enumerate(sorted(terms)[:ranks]):
                out.add((lang, source, "term", t.decode(), -value, k + 1))
    return out


def odd_words(rows):
    """Terms around 8, 16 and many bytes, some that begin alike, beyond ASCII too."""
    long_ = ["abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "abcdefghijklmnopqr", "é" * 8, "é" * 9, "日本語日本語", "x" * 300,
             "x" * 301, "ABCdefgh", "ÿÿ"]
    return [*rows, *[(1000 + k, " ".join(long_[k % 5 :] * (k % 3 + 1)) + "7" + long_[0], "de" if k % 2 else None, f"t{k % 3}" if k % 5 else None, 1)
                     for k in range(30)], (2000, "a b", "xx", "only", 1), (2001, None, "en", "empty", 1), (2002, "?", "yy", None, 1),
            (2003, "c", "yy", "one", 1)]


@pytest.mark.parametrize("chunk", [4_000_000, 500])
def test_divergence(corpus, frame, clashing, chunk, monkeypatch):
    rows = odd_words(corpus(4, 150))
    rows += [rows[0], (None, rows[3][1], "en", "s1", 1)]
    docs = clashing(frame(rows), "first", "rest", "n", "value", "rank")
    monkeypatch.setattr(source_divergence, "CHUNK", chunk)
    if chunk == 500:
        for name, value in [("BUCKET_ROWS", 70), ("BLOCK_SOURCES", 2), ("CELLS", 20)]:
            monkeypatch.setattr(source_divergence, name, value)
    got = source_divergence.divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows_got = [tuple(r) for r in got.collect()]
    assert len(rows_got) == len(set(rows_got))
    assert set(rows_got) == audit_by_brute_force(rows)
    assert {tuple(r) for r in source_divergence.divergence(docs, least=1, ranks=3).collect()} == audit_by_brute_force(rows, 1, 3)


def test_divergence_of_nothing(frame):
    assert source_divergence.divergence(frame([])).count() == 0
    alone = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "b", "en", "b", 1)]
    assert {tuple(r) for r in source_divergence.divergence(frame(alone)).collect()} == {
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_radix_order_and_shares(spark):
    rng = np.random.default_rng(5)
    for n in (0, 1, 5000):
        a, b = rng.integers(0, 5, n).astype(np.uint32), rng.integers(0, 2**64, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
        assert source_divergence.radix_order([a, b]).tolist() == np.lexsort((b, a)).tolist()
    cases = [(0, 1), (0, 7), (12, 40), (10**15 - 1, 10**15), (5 * 10**14, 9 * 10**15), (3, 9 * 10**15)]
    want = [1 + 10**9 * (c + 1) // t for c, t in cases]
    counts, totals = (np.array(x, dtype=np.int64) for x in zip(*cases))
    assert source_divergence.shares(counts, totals).tolist() == want
    from pyspark.sql import functions as F

    df = spark.createDataFrame(cases, "c long, t long").select(source_divergence.share(F.col("c"), F.col("t")).alias("p"))
    assert sorted(r.p for r in df.collect()) == sorted(want)


def judged_by_hand(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = re.search("[/?#]|$", rest).start()
        host, path = lowered(rest[:at]), re.split("[?#]", rest[at:])[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, verdict, rule = max(fits, default=(0, 0, "allow", None))
    return host, path, rule, verdict


def test_url_rules(spark, clashing):
    rules = [*url_rules.RULES, ("example.org", "/en/1", "block"), ("net", "/a", "block"), ("net", "/a", "allow"), ("co.net", "", "allow"),
             ("a.co.net", "/日本", "block"), ("", "/", "block"), ("de", "/", "hold"), ("10.0.0.1", "/x" * 900, "block"), ("b.a.com", "/", "allow"),
             ("a.com", "/a/", "block"), ("com", "/a/bc/", "allow")]
    urls = [None, "", "no scheme", "http://", "https://Example.ORG", "https://example.org/", "https://example.org?x=/es/", "http://www.example.org/es/1#top",
            "http://www.example.org/en/12", "http://www.example.org/en/21", "http://notexample.org/en/1", "ftp://x.y.com/de/?://z.org/", "http://com/fr/",
            "http://net/ab", "http://b.net/a?", "http://co.net", "http://a.co.net/日本語", "http://org./x", "http://a..org/x", "http://user@b.org:80/x",
            "http://10.0.0.1" + "/x" * 900 + "/y", "http://10.0.0.1" + "/x" * 899, "http://b.a.com/a/", "http://b.a.com/a/bc/", "://org/", "a://b://c.org/",
            "http://example.org\n/es/", "http://long.com/de/" + "y" * 20000, "http://EXAMPLE.com/FR/"]
    rows = [(k, url, "<p>") for k, url in enumerate(urls)] + [(3, urls[7], "again"), (3, urls[7], "again"), (None, urls[8], None)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "host", "path", "rule", "verdict", "lengths", "row")
    got = url_rules.judged(pages, url_rules.rule_table(spark, rules))
    assert got.columns == ["row", "host", "path", "rule", "verdict"]
    want = Counter((i, *judged_by_hand(url, rules)) for i, url, _ in rows)
    assert Counter((r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want
    assert {r.row.verdict for r in got.collect()} == {"given"}
    # Without rules, and without pages.
    none = url_rules.judged(pages, url_rules.rule_table(spark, []), default="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")} and len(none) == len(rows)
    assert url_rules.judged(pages.limit(0), url_rules.rule_table(spark)).count() == 0


def test_prefixes_that_meet_are_confirmed(spark, monkeypatch):
    """With one byte of the digest most meetings are false, and none counts."""
    rules = [(f"h{k}.org", f"/p{k}/", "block" if k % 2 else "allow") for k in range(300)]
    urls = [f"http://w.h{k}.org/p{k if k % 3 else k + 1}/x" for k in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    monkeypatch.setattr(url_rules, "PREFIX_BYTES", 1)
    got = url_rules.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {(r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {
        (k, *judged_by_hand(url, rules)) for k, url in enumerate(urls)}
