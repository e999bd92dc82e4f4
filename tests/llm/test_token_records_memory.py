"""Memory of the tasks that write token records: bounded by a slice and the pieces remembered."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quayside.llm import token_records


class Recorded:
    """Takes the place of a frame and keeps the function it is given."""

    sparkSession = SimpleNamespace(conf=None)

    def select(self, *columns):
        return self

    repartitionByRange = sortWithinPartitions = select

    def mapInArrow(self, function, schema):
        self.function = function
        return SimpleNamespace(write=SimpleNamespace(parquet=lambda path: None))


def test_writing_takes_little_memory(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_records, "read_index", lambda spark, path: None)
    docs = Recorded()
    token_records.write_records(docs, str(tmp_path), partitions=1)
    token_records._encoder.cache_clear()
    numbers = np.random.default_rng(5).integers(0, 10**9, (12, 500, 120))
    batches = [
        pa.record_batch([pa.array(range(500)), pa.array([" ".join(map(str, row)) for row in block.tolist()])], names=["doc_id", "text"])
        for block in numbers
    ]
    rows = 0
    tracemalloc.start()
    try:
        for batch in docs.function(iter(batches)):
            rows += batch.num_rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        token_records._encoder.cache_clear()
    assert rows == 6000
    assert peak < 80 << 20
