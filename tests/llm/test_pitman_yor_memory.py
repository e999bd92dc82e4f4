"""Memory of the tasks that gather tokens: given back behind each slice."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quayside.llm import pitman_yor


class Recorded:
    """Takes the place of a frame and keeps the functions it is given."""

    def mapInArrow(self, function, schema):
        self.spread = function
        return self

    def groupBy(self, name):
        return self

    def applyInArrow(self, function, schema):
        self.merge = function
        return self


def test_slices_give_memory_back(monkeypatch):
    freed = []
    monkeypatch.setattr(pitman_yor, "give_back", lambda: freed.append(1))
    monkeypatch.setattr(pitman_yor.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(pitman_yor, "_SLICE_ROWS", 2)
    steps = pitman_yor.gather(Recorded(), 1)
    docs = pa.record_batch([pa.array(range(6)), pa.array(["a b", "b", None, "a b c", "", "c"]), pa.array([True] * 6)],
                           names=["doc_id", "text", "fitted"])
    rows, at_yield = [], []
    for batch in steps.spread(iter([docs])):
        at_yield.append(len(freed))
        rows.append(batch)
    assert at_yield == [0, 1, 2] and len(freed) >= 3

    whole = pa.Table.from_batches(rows)
    bucket = whole.filter(pa.compute.equal(whole["bucket"], 0))
    merged = steps.merge(bucket)
    words, per_word, contexts, fitted, every = pitman_yor._unpack(merged["pairs"][0].as_py(), "<u8", "<u4", "<u2", "<u4", "<u4")
    assert len(words) == 4 and int(fitted.sum()) == int(every.sum()) == 7 + 6  # words and ends
    listed = steps.merge(whole.filter(pa.compute.less(whole["bucket"], 0)).slice(0, 1))
    ids, _, tokens = pitman_yor._unpack(listed["pairs"][0].as_py(), "<i8", "u1", "<i8")
    assert ids.tolist() == [0, 1] and tokens.tolist() == [3, 2] and np.all(tokens > 0)
