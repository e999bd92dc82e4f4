from __future__ import annotations

import numpy as np
import pyarrow as pa

from conftest_words import words
from quayside.llm import common
from quayside.llm.components import components


def test_words_and_hashes():
    texts = ["The  cat\tsat", None, "", "  x", "Ünï-code 日本 end\n", "y" * 40, "the CAT"]
    found = common.words_of(pa.array(texts), lowered=True)
    plain = [words(t) for t in texts]
    assert np.diff(found.first).tolist() == [len(p) for p in plain]
    spelled = [bytes(found.data[a:b]).decode() for a, b in zip(found.starts, found.ends)]
    assert spelled == [w for p in plain for w in p]
    hashes = found.hashes()
    assert len(set(hashes.tolist())) == len(set(spelled))
    assert hashes[0] == hashes[-2] and hashes[1] == hashes[-1]
    assert common.words_of(pa.array([], pa.string())).first.tolist() == [0]


def test_slices_of_an_array_with_an_offset():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", "c", None, "d e f"])], names=["text"])
    parts = list(common.slices(iter([batch.slice(1)]), "text", 1))
    assert [p["text"].to_pylist() for p in parts] == [["c", None], ["d e f"]]
    assert sum(len(common.words_of(p["text"]).starts) for p in parts) == 4


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (100, 90)]
    found = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {(k, 0) for k in range(41)} | {(90, 90), (95, 90), (100, 90)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
