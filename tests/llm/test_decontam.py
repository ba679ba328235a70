"""Decontamination against a scan of every text."""

import hashlib
import random
import re

import pytest

from tidemark.llm import decontam

from .corpus import documents, frame, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([str(i)] if i is not None else [])
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(i), len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


def case(spark):
    rows = documents(seed=21, count=40)
    texts = [t for _, t in rows]
    items = [(1, " ".join(texts[1].split()[3:25])), (2, texts[2].split()[0] + "! " + texts[2].split()[1]), (10, " ".join(texts[1].split()[5:20]).upper()), (3, None), (None, " ".join(texts[6].split()[:14])), (4, "zz yy xx"), (5, ""), (1, " ".join(texts[9].split()[:15])), (6, "x")]
    rows = rows + odd() + [(500, "zz yy. XX and zz yy xx"), (501, "zz yy")]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


def test_against_a_scan(spark):
    rows, items, benchmark = case(spark)
    out = result(decontam.contamination(frame(spark, rows), benchmark))
    assert out == brute(rows, items) and sum(r[-1] for r in out) > 3


def test_blocks(spark, monkeypatch):
    rows, items, benchmark = case(spark)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 120)
    assert result(decontam.contamination(frame(spark, rows), benchmark)) == brute(rows, items)


def test_clean_rows_stay(spark):
    rows, items, benchmark = case(spark)
    docs = frame(spark, rows)
    left = decontam.keep_clean(docs, benchmark)
    assert left.columns == docs.columns and left.count() == sum(not r[-1] for r in brute(rows, items))


def test_empty(spark):
    rows, _, benchmark = case(spark)
    assert decontam.contamination(frame(spark, []), benchmark).count() == 0
    nothing = decontam.contamination(frame(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert nothing.where("n_hit > 0 or contaminated").count() == 0 and nothing.count() == len(rows)


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    near = "zero one two three extra four five six seven nine ten eleven twelve thirteen"
    docs = frame(spark, [(1, item), (2, near), (3, "one two three and nothing else that is like it at all here")])
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontam.near(docs, benchmark).collect()} == {1: ["7"], 2: ["7"], 3: []}
    assert {r["doc_id"]: r["n_items"] for r in decontam.contamination(docs, benchmark).collect()} == {1: 1, 2: 0, 3: 0}


def test_proximity_with_terms_that_no_document_holds(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = frame(spark, [(1, item.replace("four", "quatre").replace("nine", "neuf")), (2, item.replace("four", "a").replace("nine", "b").replace("two", "c"))])
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontam.near(docs, benchmark).collect()} == {1: ["7"], 2: []}


def brute_near(rows, items, slack, missing):
    """All places of all windows, text by text."""
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            terms = words(text)
            n = min(13, len(terms))
            for k in range(len(terms) - n + 1 if n else 0):
                for start in range(-n - slack, len(w) + slack + 1):
                    places = [[p for p in range(max(0, start + o - slack), min(len(w), start + o + slack + 1)) if w[p] == terms[k + o]] for o in range(n)]
                    if sum(map(bool, places)) >= max(1, n - missing):
                        met = [p for ps in places for p in ps]
                        hit.update(range(min(met), max(met) + 1))
                        found |= {str(item)} if item is not None else set()
        out.append((str(i), len(w), sorted(hit), sorted(found)))
    return sorted(out)


def near_result(df):
    return sorted((str(r["doc_id"]), r["n_words"], sorted(r["hits"]), r["items"]) for r in df.collect())


@pytest.mark.parametrize("slack,missing", [(3, 2), (0, 2), (2, 0)])
def test_proximity_against_a_scan(spark, slack, missing):
    g = random.Random(slack)
    item = [f"t{g.randrange(14)}" for _ in range(16)]
    items = [(1, " ".join(item)), (None, "zz yy xx"), (3, None), (4, ""), (5, "lone"), (1, " ".join(item))]
    rows = odd()[:9] + [(600, " ".join(item[4:])), (601, " ".join(item[:-4])), (602, "zz"), (603, "yy xx"), (604, "lone")]
    for k in range(40):
        w = item[:]
        for _ in range(g.randrange(6)):
            at = g.randrange(len(w))
            w[at : at + g.choice([0, 1])] = g.choice([[], ["extra"], [g.choice(item)]])
        cut = g.choice([0, 0, len(w) // 2])
        rows += [(k, " ".join(w[cut:])), (100 + k, " ".join(["a b c", *w, "d e"])), (200 + k, " ".join(w[:cut]))]
    out = near_result(decontam.near(frame(spark, rows).coalesce(1), spark.createDataFrame(items, "item_id long, text string"), slack, missing))
    assert out == brute_near(rows, items, slack, missing)
    assert sum("1" in r[3] for r in out) > 20


def test_proximity_of_nothing(spark):
    _, _, benchmark = case(spark)
    assert decontam.near(frame(spark, []), benchmark).count() == 0
    nothing = decontam.near(frame(spark, odd()), spark.createDataFrame([], "item_id long, text string"))
    assert nothing.where("size(hits) > 0 or size(items) > 0").count() == 0 and nothing.count() == len(odd())
