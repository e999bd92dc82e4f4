from __future__ import annotations

import random

import pytest


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"



@pytest.fixture(autouse=True)
def shared(spark, tmp_path_factory):
    """A shared folder of the test's own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def corpus(spark):
    """Documents with copies, shared passages, odd white space, nulls, ties and long texts."""

    def make(seed=1, size=60):
        rng = random.Random(seed)
        vocabulary = [f"w{rng.randrange(400)}" for _ in range(400)] + ["The", "of", "Ünï", "日本"]
        passage = " ".join(rng.choice(vocabulary) for _ in range(70))
        rows, texts = [], []
        for k in range(size):
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 160)))
            if k % 5 == 1 and texts:
                text = rng.choice(texts)
            elif k % 5 == 2 and texts:
                parts = rng.choice(texts).split(" ")
                parts[rng.randrange(len(parts))] = "changed"
                text = " ".join(parts)
            elif k % 5 == 3:
                text = text + "\n" + passage + "\n" + text[:20]
            texts.append(text)
            rows.append((k, text, "en", f"s{k % 4}" if k % 7 else None, len(text)))
        rows += [(size, None, None, None, None), (size + 1, "", "en", "s1", 0), (size + 2, " \t\n ", "en", "s1", 4),
                 (size + 3, "One  two\tthree\r\nfour", "en", "s1", 20), (size + 4, "word " * 3000, "en", "s9", 15000),
                 (size + 5, "x" * 5000, "en", "s9", 5000)]
        return rows

    return make


@pytest.fixture
def frame(spark):
    def make(rows, schema=DOCUMENTS):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture
def clashing():
    """`docs` with more columns, named as operators name their own."""

    def add(docs, *names):
        from pyspark.sql import functions as F

        for name in names:
            docs = docs.withColumn(name, F.lit("given"))
        return docs

    return add
