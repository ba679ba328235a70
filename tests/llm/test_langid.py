"""Language identification: held-out accuracy, what it must not look at, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

from tidemark.llm import langid

from .corpus import frame, odd

PARTS = {"aa": ["ka", "ro", "mi", "tul", "es"], "bb": ["sch", "un", "gen", "ber", "lich"], "cc": ["qu", "eau", "ion", "ré", "ment"]}
SCHEMA = "doc_id long, text string, lang string, LANG string"


def corpus(count=240):
    g = random.Random(4)
    rows = []
    for i in range(count):
        lang = "abc"[i % 3] * 2
        words = ["".join(g.choice(PARTS[lang]) for _ in range(g.randrange(1, 4))) for _ in range(30)]
        rows.append((i, " ".join(words), lang, None))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {r[0] for r in held} == {i for i, r in out.items() if r["held_out"]} and held
    assert sum(out[i]["lang_pred"] == lang for i, _, lang, _ in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_labels_are_no_input(spark):
    rows = corpus(90)
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    swapped = [(i + 1000, t, "zz", None) for i, t, _, _ in rows]
    a = [r["lang_pred"] for r in langid.predict(spark.createDataFrame(rows, SCHEMA), model).orderBy("doc_id").collect()]
    b = [r["lang_pred"] for r in langid.predict(spark.createDataFrame(swapped, SCHEMA), model).orderBy("doc_id").collect()]
    assert a == b


def test_held_out_rows_teach_nothing(spark):
    rows = corpus(90)
    other = [(i, t if zlib.crc32(str(i).encode()) % 4 != 2 else "zzz yyy", lang, None) for i, t, lang, _ in rows]
    a, b = langid.fit(spark.createDataFrame(rows, SCHEMA)), langid.fit(spark.createDataFrame(other, SCHEMA))
    assert a.entries == b.entries and (a.table == b.table).all()


def test_backing_off():
    model = langid.model_of(["x", "y"], [("x", "w:known", 5, 10), ("y", "w:other", 5, 10), ("x", "3: ab", 9, 20), ("y", "1:z", 3, 20)])
    scorer = langid.Scorer(model)
    assert scorer.predict("known")[0] == "x" and scorer.predict("abq")[0] == "x" and scorer.predict("zq")[0] == "y"
    assert scorer.predict("12 ?") == ("und", 0.0) and scorer.predict(None) == ("und", 0.0)
    assert scorer.predict("qqq") == ("x", 0.5)  # nothing known: the first


def test_small_memory(monkeypatch):
    model = langid.model_of(["x", "y"], [("x", "w:known", 5, 10), ("y", "1:z", 3, 20), ("x", "1:a", 3, 20)])
    text = " ".join(f"{c}z" for c in "bcdefghijklmn") + " a known"
    large = langid.Scorer(model).sums([langid.words(text)])
    monkeypatch.setattr(langid, "MEMORY", 5)
    small = langid.Scorer(model)
    for _ in range(3):
        assert abs(small.sums([langid.words(text)]) - large).max() < 1e-4


def test_words():
    everything = "".join(map(chr, range(256)))
    assert langid.words(everything) == langid._WORD.findall(everything.lower())
    assert langid.words("Één Straße \u0416\u0437 x_1y") == ["één", "straße", "\u0436\u0437", "x", "y"]


def test_odd_rows(spark):
    docs = frame(spark, odd())
    out = langid.predict(docs, langid.fit(docs)).collect()
    assert len(out) == len(odd()) and {r["lang_pred"] for r in out if r["doc_id"] in (-1, -2, -3, -6)} == {"und"}
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns and kept.count() == sum(r["lang_pred"] != "und" for r in out)
    empty = frame(spark, [])
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def plain_scores(rows, texts):
    """The model and its scores by plain dictionaries of all entries."""
    counts, totals = {}, {}
    for i, text, lang, _ in rows:
        if i is None or text is None or lang is None or zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            parts = [("w", word)] + [(1, c) for c in word]
            parts += [(n, f" {word} "[k : k + n]) for n in range(2, 6) for k in range(len(word) + 3 - n)]
            for entry in parts:
                counts.setdefault(lang, Counter())[entry] += 1
                totals[lang, entry[0]] = totals.get((lang, entry[0]), 0) + 1
    langs = sorted(counts)
    known = {e for c in counts.values() for e, n in c.items() if e[0] != "w" or n > 1}

    def rate(entry):
        kept = [counts[x][entry] if entry[0] != "w" or counts[x][entry] > 1 else 0 for x in langs]
        return [math.log((n + 0.5) / totals[x, entry[0]]) for x, n in zip(langs, kept)]

    def word_score(word):
        if ("w", word) in known:
            out, weight = rate(("w", word)), 1.0
        else:
            for n in range(5, 0, -1):
                source = f" {word} " if n > 1 else word
                found = [e for k in range(len(source) - n + 1) if (e := (n, source[k : k + n])) in known]
                if found:
                    break
            else:
                return [0.0] * len(langs)
            out, weight = [sum(x) / len(found) for x in zip(*map(rate, found))], 0.6
        return [(x - max(out)) * weight for x in out]

    for text in texts:
        found = [word_score(w) for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        if not found:
            yield "und", 0.0
            continue
        sums = [sum(x) for x in zip(*found)]
        yield langs[sums.index(max(sums))], 1 / sum(math.exp(x - max(sums)) for x in sums)


def test_against_plain_scoring(spark):
    rows = corpus(150)
    short = [(1000 + i, " ".join(t.split()[i % 7 : i % 7 + 1 + i % 2] + ["zzq", t[3:9]]), None, None) for i, t, _, _ in rows[:60]]
    short += [(2000, None, "aa", None), (2001, "12 _ !", "aa", None), (2002, "ΩΩΩ", None, None)]
    docs = spark.createDataFrame(rows + short, SCHEMA)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.fit(docs)).collect()}
    everything = rows + short
    for (i, text, _, _), (lang, score) in zip(everything, plain_scores(everything, [r[1] for r in everything])):
        assert abs(got[i][1] - score) < 1e-4, text
        assert got[i][0] == lang or score < 0.51, text
