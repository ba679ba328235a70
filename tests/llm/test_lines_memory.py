"""What a worker of the line dedup holds at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import common, lines

from .corpus import sentence


class Captured:
    """Takes the function that a DataFrame's batches would go through."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, run, schema):
        return run


def test_arrays_of_a_batch_are_bounded(spark, monkeypatch):
    g = random.Random(3)
    texts = [sentence(g, 400) for _ in range(1600)]
    assert 2 << 20 < sum(map(len, texts)) < 4 << 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(1600), pa.int64()), pa.array(texts), pa.array(range(1600), pa.int64())], ["doc_id", "text", "n"])
    monkeypatch.setattr(common, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    run = lines.pieces(Captured(spark))
    tracemalloc.start()
    units = sum(part.num_rows for part in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert units > 1200 and peak < 30 << 20
