from __future__ import annotations

from collections import Counter

import corpus_pipeline
from conftest_words import words
from test_operators import groups_by_brute_force, passages_by_brute_force


def test_pipeline(spark, corpus, frame, tmp_path):
    """Each stage against a plain version, on what the one before kept."""
    rows = corpus(9, 120)
    # Some toxic documents, told by their words.
    rows = [(i, f"you idiot {t} moron" if t and i % 9 == 4 else t, a, b, n) for i, t, a, b, n in rows]
    rows += [rows[0], (None, "a row without an id", "en", "s1", 1)]
    folder = str(tmp_path)
    docs = frame(rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 4 and bool(t))) for i, t, *_ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    items = [(1, " ".join(words(rows[11][1])[:30])), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    now, given = [tuple(r) for r in docs.collect()], docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, given, folder)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        kept = [tuple(r) for r in out.collect()]
        if name == "toxicity":
            gone = {r[0] for r in now} - {r[0] for r in kept}
            toxic = {i for i, t, *_ in rows if t and i is not None and i % 9 == 4}
            assert len(gone & toxic) >= 0.8 * len(toxic) and len(gone - toxic) <= 0.1 * len(rows) and None not in gone
        elif name == "n-gram Jaccard join":
            roots = {i for i, _, c in groups_by_brute_force([r for r in now if r[0] is not None]) if i == c}
            assert Counter(r[0] for r in kept) == Counter(roots | {None})
        elif name == "benchmark decontamination":
            bad = {r[0] for r in passages_by_brute_force(now, items)}
            assert {r[0] for r in kept} == {r[0] for r in now} - bad
        else:
            assert set(kept) <= set(now) and max(Counter(kept).values()) <= 3
        now, given = kept, out
    last = corpus_pipeline.STAGES[4][1](spark, given, folder).collect()
    assert Counter(r.doc_id for r in last) == Counter(r[0] for r in now)
    assert corpus_pipeline.run(spark, folder).count() == len(now)


def test_stages_keep_columns_named_as_their_own(spark, corpus, frame, clashing, tmp_path):
    """No stage fails on, or overwrites, a column the documents bring along."""
    rows = corpus(4, 40)
    names = ["_score", "_spans", "_id", "_found", "_source", "_size", "_copies", "_number", "_text_key", "text_key", "row", "component_id", "n", "low"]
    docs, folder = clashing(frame(rows), *names), str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(rows[11][1])[:30]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns[-len(names):] == names and docs.count() > 10
        assert {tuple(r) for r in docs.select(*names).distinct().collect()} == {("given",) * len(names)}
    assert corpus_pipeline.STAGES[4][1](spark, docs, folder).count() == docs.count()


def test_ids_with_several_texts(spark, frame, tmp_path):
    """Each dissimilar text of an id stays, copies of it go, and ids without one text are not mixed up."""
    one, two, three = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 2), (1, two, "en", "s", 2), (2, two, "de", "s", 3), (3, three, "en", "s", 4), (3, None, "en", "s", 5),
            (4, None, "en", "s", 6), (5, one + " more", "en", "s", 7), (None, one, "en", "s", 8), (None, one, "en", "s", 8), (6, "alone", "en", "s", 9)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, frame(rows), str(tmp_path)).collect()
    # The two texts of id 1 stay once each; copies under 2 and 5 go; rows without an id stay.
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted(
        [(1, one), (1, two), (3, three), (3, ""), (4, ""), (0, one), (0, one), (6, "alone")])
    same = [(1, one, "en", "s", 1), (1, one, "de", "s", 2), (2, two, "en", "s", 1), (7, two, "en", "s", 1)]
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, frame(same), str(tmp_path)).collect()) == [1, 2]
