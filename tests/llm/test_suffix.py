"""Suffix dedup against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix

from .corpus import documents, frame, odd


def brute(rows, length):
    """doc_id -> (n_bytes, n_removed, n_spans, digest) of each row, as a sorted list."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((str(i), len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("length,gram,group", [(60, 24, None), (60, 24, 2), (400, 160, None)])
def test_against_counts(spark, length, gram, group):
    rows = documents(seed=length) + odd() + [(900, "abcab" * 300), (901, "x" * 700), (902, "q" + "x" * 650)]
    assert result(suffix.dedup(frame(spark, rows), length, gram, group)) == brute(rows, length)


def test_small_units(spark, monkeypatch):
    monkeypatch.setattr(suffix, "TOGETHER", 7)
    monkeypatch.setattr(suffix, "CHUNK", 500)
    rows = documents(seed=9, count=40)
    assert result(suffix.dedup(frame(spark, rows), 50, 20)) == brute(rows, 50)


def test_kept_and_spans(spark):
    r = suffix.dedup(frame(spark, [(1, "a" * 10 + "0123456789" * 6), (2, "b" * 10 + "0123456789" * 6)]), 60, 20).orderBy("doc_id").collect()
    assert [bytes(x["kept"]) for x in r] == [b"a" * 10, b"b" * 10] and [(s["start"], s["end"]) for s in r[0]["removed"]] == [(10, 70)]


def test_empty(spark):
    assert suffix.dedup(frame(spark, [])).count() == 0


def test_suffix_order():
    g = random.Random(4)
    texts = [bytes(g.choice(b"ab") for _ in range(g.randrange(0, 30))) for _ in range(400)]
    data = np.frombuffer(b"".join(texts) + b"-", np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    group = np.sort(np.array([g.randrange(20) for _ in texts]))
    order, shared = suffix.Suffixes(data, start, size, group).order()
    found = [(int(group[i]), texts[i]) for i in order]
    assert found == sorted(found)
    for k in range(len(order) - 1):
        a, b = texts[order[k]], texts[order[k + 1]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == (n if group[order[k]] == group[order[k + 1]] else -1)


def test_a_collision_is_noticed(monkeypatch):
    data = np.frombuffer(b"abxabyabz-", np.uint8)
    real = suffix._tables
    monkeypatch.setattr(suffix, "_tables", lambda seed: np.zeros(256, np.uint64) if seed == 3 else real(seed))
    s = suffix.Suffixes(data, np.array([0, 3, 6]), np.array([3, 3, 3]), np.zeros(3, np.int64))
    order, shared = s.order()
    assert s.seed > 3 and list(order) == [0, 1, 2] and list(shared) == [2, 2, -1]
