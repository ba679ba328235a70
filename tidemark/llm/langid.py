"""Language identification by words first, then ever shorter character n-grams.

A model holds, for each language, log frequencies of words and of character
n-grams (words in blanks, so that beginnings and ends differ). A known word scores
by its frequencies; an unseen word by those of its n-grams of the greatest length
at which any is known, and one that matches nothing says nothing. A document's
score is the softmax of the sums over all its words.

fit() learns from at most about PER_LANGUAGE labelled documents of each language
(chosen by a hash of doc_id, whole texts), and keeps the WORDS and (of each
length) GRAMS most frequent entries of each language; these bounds make the model's size independent
of the corpus, so it is broadcast.

Null text, or text without a letter: language ``und``, score 0; so is every
document if nothing can be learned. Rows with a null doc_id are never learned
from and are not held out. Ties between languages fall to the first in
alphabetical order. Repeated rows are predicted each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

PER_LANGUAGE = 2000
WORDS = 15_000
GRAMS = 5_000
LONGEST = 5
#: Added to every count.
SMOOTH = 0.5
#: What an n-gram of an unseen word weighs against a known word.
BACKOFF = 0.6
#: Unseen words that a worker remembers the scores of.
MEMORY = 150_000
#: Text bytes whose words a worker that only keeps documents holds at once.
SLICE_BYTES = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _latin_table() -> bytes:
    """What each Latin-1 character is to words(): itself in lower case, or a blank between words."""
    return b"".join((c.lower() if _WORD.fullmatch(c) else " ").encode("latin-1") for c in map(chr, range(256)))


_LATIN = _latin_table()


def words(text: str) -> list[str]:
    """Lower-case runs of letters. Latin-1 texts, by a table, have the same words as others."""
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word in blanks (a single letter has no blanks)."""
    if n == 1:
        return list(word)
    framed = f" {word} "
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


class Model:
    """Entries and their log frequencies, one column per language."""

    def __init__(self, languages: list[str], entries: dict[str, int], table: np.ndarray):
        self.languages, self.entries, self.table = languages, entries, table


class Scorer:
    """Scores texts by a model, remembering unseen words."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        entries = self.model.entries
        self.rows = {k[2:]: v for k, v in entries.items() if k.startswith("w:")}
        self.grams = [{k[2:]: v for k, v in entries.items() if k.startswith(f"{n}:")} for n in range(LONGEST + 1)]
        self.used = len(self.model.table)
        self.table = np.concatenate([self.model.table, np.zeros((MEMORY, len(self.model.languages)), np.float32)])
        known = self.table[: self.used]
        if known.size:
            known -= known.max(1, keepdims=True)

    def _known_grams(self, word: str) -> list[int]:
        """Entries of the word's n-grams of the greatest length at which any is known."""
        framed = f" {word} "
        for n in range(min(LONGEST, len(framed)), 0, -1):
            get = self.grams[n].get
            if n == 1:
                framed = word
            found = [r for i in range(len(framed) - n + 1) if (r := get(framed[i : i + n])) is not None]
            if found:
                return found
        return []

    def unseen(self, new: list[str]) -> np.ndarray:
        """Scores of words that aren't known."""
        lists = [self._known_grams(w) for w in new]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        out = np.zeros((len(new), len(self.model.languages)), np.float32)
        some = sizes > 0
        if some.any():
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
            starts = np.cumsum(sizes[some]) - sizes[some]
            means = np.add.reduceat(self.model.table[flat], starts, axis=0) / sizes[some, None]
            out[some] = (means - means.max(1, keepdims=True)) * BACKOFF
        return out

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Sums of the words' scores of each text."""
        new = list(set(chain.from_iterable(texts)).difference(self.rows))
        if self.used + len(new) > len(self.table):
            self._reset()
            new = list(set(chain.from_iterable(texts)).difference(self.rows))
        room = len(self.table) - self.used
        extra: dict[str, np.ndarray] = {}
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            scores = self.unseen(part)
            fit = max(0, min(len(part), room - at))
            self.table[self.used : self.used + fit] = scores[:fit]
            self.rows.update(zip(part[:fit], range(self.used, self.used + fit)))
            self.used += fit
            extra.update(zip(part[fit:], scores[fit:]))  # more unseen words than the memory holds
        out = np.zeros((len(texts), len(self.model.languages)), np.float64)
        rows = self.rows
        for i, ws in enumerate(texts):
            if extra:
                out[i] = sum((extra[w] if w in extra else self.table[rows[w]] for w in ws), np.zeros(out.shape[1]))
            elif ws:
                out[i] = self.table[[rows[w] for w in ws]].sum(0, dtype=np.float64)
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        split = [words(t) if t and self.model.languages and any(c.isalpha() for c in t) else None for t in texts]
        sums = iter(self.sums([ws for ws in split if ws is not None]))
        out = []
        for ws in split:
            if ws is None:
                out.append(("und", 0.0))
                continue
            s = next(sums)
            best = int(s.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(s - s[best]).sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of one text."""
        return self.predict_all([text])[0]


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, entry, n): words as ``w:word``, n-grams as ``n:gram``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            found: dict[str, Counter] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(words(text))
            rows: list[tuple] = []
            for lang, counter in found.items():
                all_grams: Counter = Counter()
                for w, n in counter.items():
                    rows.append((lang, "w:" + w, n))
                    for k in range(1, min(LONGEST, len(w) + 2) + 1):
                        for g in grams(w, k):
                            all_grams[f"{k}:{g}"] += n
                rows += [(lang, g, n) for g, n in all_grams.items()]
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], ["lang", "entry", "n"])

    parts = sample.mapInArrow(run, "lang string, entry string, n long")
    return parts.groupBy("lang", "entry").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Model:
    """A model of the labelled documents that aren't held out."""
    rows = common.pick(docs, doc_id="long", text="string", lang="string")
    train = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return Model([], {}, np.zeros((0, 0), np.float32))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, PER_LANGUAGE / n))).otherwise(share)
    sample = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    kind = F.when(F.col("entry").startswith("w:"), F.lit("w")).otherwise(F.lit("g"))
    counts = _counts(sample).withColumn("kind", F.substring("entry", 1, 2))
    order = W.partitionBy("lang", "kind").orderBy(F.desc("n"), "entry")
    totals = F.sum("n").over(W.partitionBy("lang", "kind"))
    limit = F.when(kind == "w", F.lit(WORDS)).otherwise(F.lit(GRAMS))
    top = counts.withColumn("total", totals).withColumn("place", F.row_number().over(order)).where((F.col("place") <= limit) & ((kind == "w") & (F.col("n") > 1) | (kind == "g")))
    found: list[Row] = top.select("lang", "entry", "n", "total", "kind").collect()  # WORDS + LONGEST * GRAMS rows for each language
    return model_of(sorted(sizes), [(r["lang"], r["entry"], r["n"], r["total"]) for r in found])


def model_of(languages: list[str], rows: list[tuple[str, str, int, int]]) -> Model:
    """The model of (language, entry, count, total of the entry's kind)."""
    entries = {e: i for i, e in enumerate(sorted({r[1] for r in rows}))}
    column = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(entries), len(languages)))
    most: dict[str, int] = {}
    for _, entry, _, total in rows:
        most[entry[:2]] = max(total, most.get(entry[:2], 1))
    totals = {(kind, name): n for kind, n in most.items() for name in languages}  # of kinds that a language has nothing of
    for lang, entry, n, total in rows:
        counts[entries[entry], column[lang]] = n
        totals[entry[:2], lang] = total
    table = np.log(counts + SMOOTH)
    for entry, i in entries.items():
        for name, j in column.items():
            table[i, j] -= math.log(totals[entry[:2], name])
    return Model(languages, entries, table.astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; only the text is looked at for the last two."""
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.entries, model.table))
    scorer: list[Scorer] = []

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not scorer:
            scorer.append(Scorer(Model(*held.value)))
        found = scorer[0].predict_all(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    picked = common.pick(docs, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), "text")
    return common.over_text(picked, rows, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text has a language."""
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.entries, model.table))
    at = common.column_at(docs.columns, "text")
    if at is None:  # nothing has a language
        return docs.where(F.lit(False))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    scorer: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not scorer:
            scorer.append(Scorer(Model(*held.value)))
        for part in common.slices(batches, f"c{at}", SLICE_BYTES):
            keep = [lang != "und" for lang, _ in scorer[0].predict_all(part.column(at).to_pylist())]
            yield part.filter(pa.array(keep, pa.bool_()))
        scorer.clear()  # its words are a worker's largest share
        common.release()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
