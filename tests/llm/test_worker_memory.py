"""What a worker holds in the first stages of the pipeline, and what it leaves to the next task."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import common, langid, minmax

from .corpus import sentence


class Captured:
    """A frame of doc_id and text that takes the function its batches would go through."""

    columns, schema = ["doc_id", "text"], None

    def __init__(self, spark):
        self.sparkSession = spark

    def toDF(self, *names):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def batch_of(g: random.Random) -> pa.RecordBatch:
    texts = [sentence(g, 400) for _ in range(1600)]
    assert 2 << 20 < sum(map(len, texts)) < 4 << 20
    return pa.RecordBatch.from_arrays([pa.array(range(1600), pa.int64()), pa.array(texts)], ["doc_id", "text"])


def traced(run, batch: pa.RecordBatch) -> tuple[int, int, int]:
    """Rows out, and Python's and numpy's bytes at the peak and afterwards."""
    tracemalloc.start()
    rows = sum(part.num_rows for part in run(iter([batch])))
    left, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return rows, peak, left


def test_sketches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(common, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    rows, peak, left = traced(minmax.sketches(Captured(spark)).run, batch_of(random.Random(5)))
    assert rows == 1600 and peak < 30 << 20 and left < 4 << 20


def test_language_stage_leaves_nothing(spark):
    texts = [sentence(random.Random(i), 50) for i in range(50)]
    entries = {("xx", f"w:{w}", 2, 1000) for t in texts for w in langid.words(t)} | {("xx", f"1:{c}", 2, 1000) for c in "abcdefgh"}
    docs = Captured(spark)
    langid.keep_identified(docs, langid.model_of(["xx"], sorted(entries)))
    rows, peak, left = traced(docs.run, batch_of(random.Random(6)))
    assert rows == 1600 and left < 1 << 19


def test_powers_after_release(monkeypatch):
    monkeypatch.setattr(common, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    up, down = common.powers(common.POWERS + 5)
    assert len(up) == len(down) == 2 * common.POWERS and ((up * down) == 1).all()
    up, _ = common.powers((1 << 20) + 5)
    assert len(up) == (1 << 20) + common.POWERS
    common.release()
    kept, inverse = common.powers(10)
    assert len(kept) == common.POWERS and (kept == up[: common.POWERS]).all() and ((kept * inverse) == 1).all()
