"""Near-dedup against all pairs."""

import re

import numpy as np

from tidemark.llm import minmax
from tidemark.llm.graph import components

from .corpus import documents, frame, odd


def brute(rows):
    """(doc_id, set size, component) with ids as nodes."""
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())))
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((str(i), len(s), str(None if i is None else root(i)), i is None or root(i) == i) for i, s in sets)


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def test_against_all_pairs(spark, monkeypatch):
    rows = documents(seed=3, count=60) + odd()
    assert result(minmax.components(frame(spark, rows))) == brute(rows)
    assert len({r[2] for r in brute(rows)}) < len(rows) - 5


def test_groups_are_split(spark, monkeypatch):
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(40):  # a family whose members are near some of the others only
        words = list(base)
        for k in range(i % 4):
            words[(17 * i + 40 * k) % 120] = f"u{i}.{k}"
        rows.append((i, " ".join(words)))
    expected = brute(rows)
    assert result(minmax.components(frame(spark, rows))) == expected
    monkeypatch.setattr(minmax, "UNIT_SHINGLES", 600)  # eight parts or so
    assert result(minmax.components(frame(spark, rows))) == expected
    monkeypatch.setattr(minmax, "UNIT_SHINGLES", 1 << 20)
    monkeypatch.setattr(minmax, "UNIT_MEMBERS", 11)
    assert result(minmax.components(frame(spark, rows))) == expected


def test_all_columns_are_kept(spark):
    docs = frame(spark, documents(seed=5, count=30) + odd())
    left = minmax.keep_one(docs)
    assert left.columns == docs.columns
    kept = minmax.components(docs).where("kept").count()
    assert left.count() == kept
    assert minmax.components(frame(spark, [])).count() == 0


def test_band_recall():
    g = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        a = g.integers(0, 2**63, 400, dtype=np.uint64)
        b = a.copy()
        b[:30] = g.integers(0, 2**63, 30, dtype=np.uint64)  # similarity 370 / 430
        missed += not (minmax.bands(minmax.signature(a)) == minmax.bands(minmax.signature(b))).any()
    assert missed == 0


def test_components(spark):
    chain = [(i + 1, i) for i in range(0, 60)] + [(200, 100), (100, 300), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_large_group_of_near_copies_is_linear(spark, monkeypatch):
    """Members of one hub that are near copies of it: as many rows as members and parts, and nothing is left to pair up."""
    monkeypatch.setattr(minmax, "UNIT_MEMBERS", 50)
    for n in (600, 1200):
        sets = [np.unique(np.r_[np.arange(100), 1000 + i]).astype(np.uint64) for i in range(n)]
        members = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, size long, shingles binary")
        groups = spark.createDataFrame([(0, i) for i in range(n)], "hub long, node long")
        rows = minmax._with_hub(groups, members)
        assert rows.count() == n - 1 + n // 50
        beside = minmax._beside_hub(rows)
        assert beside.where("linked").count() == n - 1 == beside.count()
        assert minmax._units(beside, members).count() == 0


def test_one_id_with_several_texts(spark):
    """Every text of an id links it, also if two of its texts have equally many shingles."""
    base, other = [f"t{k}" for k in range(40)], [f"s{k}" for k in range(40)]
    rows = [(1, " ".join(base)), (1, " ".join(other)), (2, " ".join([*base[:39], "x"])), (3, " ".join([*other[:39], "y"])), (4, "nothing like it at all")]
    out = {(r["doc_id"], r["component_id"]) for r in minmax.components(frame(spark, rows)).collect()}
    assert out == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_without_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "id long, body string")
    assert minmax.keep_one(docs).count() == 1
    assert minmax.keep_one(docs.toDF("DOC_ID", "Text")).columns == ["DOC_ID", "Text"]
