"""The pipeline against its stages in plain Python, and the registration of its queries."""

import pytest

import __spark_entry__
import corpus_pipeline
from tidemark.llm import lines
from tidemark.llm.common import pick, stage

from . import test_decontam, test_minmax
from .corpus import documents, frame, odd


def test_registration():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *(next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11))} <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "bpe"]


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    rows = [] if empty else documents(seed=31, count=30) + [r for r in odd() if r[0] is not None]
    text = documents(seed=31, count=30)[8][1]
    items = [(1, " ".join(text.split()[:20]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    pick(frame(spark, rows), doc_id="long", text="string", lang="string", source="string", n_chars="long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs, now = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(tmp_path))
        if name == "bpe":
            assert out.count() == len(now)
            break
        out = stage(out.coalesce(1), name)
        assert out.columns == list(columns)
        got = sorted((r["doc_id"], r["text"]) for r in out.collect())
        if name == "language_id":
            now = [(i, t) for i, t in now if t and any(c.isalpha() for c in t)]
        elif name == "near_dedup":
            kept = {r[0] for r in test_minmax.brute(now) if r[3]}
            now = [(i, t) for i, t in now if str(i) in kept]
        elif name == "substring_dedup":
            assert [i for i, _ in got] == sorted(i for i, _ in now)
            whole = lines.dedup(docs)
            assert got == sorted((r["doc_id"], r["text"]) for r in whole.collect())
            now = got
        else:
            bad = {r[0] for r in test_decontam.brute(now, items) if r[-1]}
            now = [(i, t) for i, t in now if str(i) not in bad]
            assert empty or bad
        assert got == sorted(now)
        docs = out
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == len(now)
