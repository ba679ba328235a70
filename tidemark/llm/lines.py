"""Substring dedup by hashing lines and windows of words.

Units are lines, and windows of MIN_WORDS words, of which those are taken whose hash is
the least of SPAN windows that begin one after the other (ties too): texts that share
MIN_WORDS + SPAN - 1 words, wherever these stand, have a unit in common. Windows run
across line ends. Units are normalised (ASCII case, white space) and hashed, digests are
grouped over all documents, and the occurrence with the smallest (doc_id, row, place)
stays. A line that an earlier row holds goes whatever its length; one that only its
own row holds above goes from MIN_BYTES bytes or MIN_WORDS words on. A later window is
laid beside the first one's text, REACH words more to both sides, and the whole run of
equal words around it goes. Offsets of what was removed are those of the original text,
in code points.

Null text stays null with nothing removed; empty text stays empty. Null doc_ids
rank after all others. Of repeated rows the first in input order keeps its text.
Words are runs of characters other than ASCII white space; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 16
SPAN = 16
#: Words compared beyond a window; at SPAN words the next common window takes over.
REACH = 32
#: Fewer equal words than this beyond a line's end are taken for chance, unless they are the whole line.
CHANCE = 4
#: Least length of a line that goes because its own row holds it above.
MIN_BYTES = 80
#: Text bytes that a worker cuts in units at once: their arrays take some 70 times as much.
SLICE_BYTES = 1 << 18

#: Keeps digests of lines apart from those of windows.
_LINE = np.uint64(0x2545F4914F6CDD1D)

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(text: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = common.word_spans(data, _WORD)
    return starts, ends, common.span_hashes(_LOWER[data], starts, ends)


class Pieces:
    """The units of one batch of texts: arrays over units; of each text first its windows, then its lines.

    words: what a unit counts for against MIN_WORDS. A line is enough by itself.
    """

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        starts, ends, hashes = _words(data)
        n = len(starts)
        lines = np.cumsum(data == 10)[starts] if n else np.zeros(0, np.int64)
        begins = np.ones(n, bool)  # the first word of a line
        begins[1:] = lines[1:] != lines[:-1]
        heads = np.flatnonzero(begins)
        up, down = common.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=sums[1:])
        self.starts, self.ends = starts, ends
        self.head = begins  # of each word: begins its line
        self.word_of = np.searchsorted(starts, self.offsets)  # the first word of each text, and the number of words
        windows = np.zeros(max(0, n - MIN_WORDS + 1), np.uint64)
        if len(windows):
            windows = common.mix((sums[MIN_WORDS:] - sums[:-MIN_WORDS]) * down[: len(windows)] + np.uint64(MIN_WORDS))
        first = _least(windows, self.word_of)
        a = np.concatenate([first, heads])
        b = np.concatenate([first + MIN_WORDS, np.append(heads, n)[1:]])
        whole = np.arange(len(a)) >= len(first)
        text = np.searchsorted(self.offsets, starts[a], "right") - 1
        unit = np.argsort(text, kind="stable")
        self.a, self.b, self.whole, self.text = a[unit], b[unit], whole[unit], text[unit]
        sizes = self.b - self.a
        self.word = hashes
        self.hash = common.mix((sums[self.b] - sums[self.a]) * down[self.a] + sizes.astype(np.uint64) ^ np.where(self.whole, _LINE, np.uint64(0))).view(np.int64)
        self.words = np.where(self.whole, np.maximum(sizes, MIN_WORDS), sizes)
        self.first_of = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.place = np.arange(len(self.a)) - self.first_of[self.text]


def _least(windows: np.ndarray, word_of: np.ndarray) -> np.ndarray:
    """Where windows begin that are the least of SPAN in a row; of a text with fewer, the least of all."""
    counts = np.maximum(0, np.diff(word_of) - MIN_WORDS + 1)
    at = np.repeat(word_of[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    # texts are laid out apart, so that no row of SPAN reaches from one into the next
    slot = np.repeat(np.cumsum(counts + SPAN) - counts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    top = np.iinfo(np.uint64).max
    size = int((counts + SPAN).sum()) + SPAN
    laid = np.full(size, top)
    laid[slot] = windows[at]
    least, most = laid.copy(), np.zeros(size, np.uint64)
    for d in range(1, SPAN):
        np.minimum(least[:-d], laid[d:], out=least[:-d])
    full = np.zeros(size, bool)  # a row begins here that lies within its text, or is all of it
    left = np.repeat(counts, counts) - (slot - np.repeat(np.cumsum(counts + SPAN) - counts, counts))
    full[slot] = (left >= SPAN) | (left == np.repeat(counts, counts))
    least[~full] = 0
    for d in range(SPAN):
        np.maximum(most[d:], least[: size - d], out=most[d:])
    return at[most[slot] == windows[at]]


def _numbered(docs: DataFrame) -> DataFrame:
    return common.numbered(docs, doc_id="long", text="string")


def pieces(rows: DataFrame) -> DataFrame:
    """(h, doc_id, n, place, word) of every unit; word: where a window begins, counted in its text, or -1 for a line."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = Pieces(common.utf8(batch, "text"))
        at = pa.array(p.text)
        ids, n = batch.column(0).take(at), batch.column(2).take(at)
        word = np.where(p.whole, -1, p.a - p.word_of[p.text])
        return pa.RecordBatch.from_arrays([pa.array(p.hash), ids, n, pa.array(p.place.astype(np.int32)), pa.array(word.astype(np.int32))], ["h", "doc_id", "n", "place", "word"])

    return common.over_text(rows, run, "h long, doc_id long, n long, place int, word int", limit=SLICE_BYTES)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(flags, prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _cut(text: bytes, p: Pieces, i: int, gone: np.ndarray, own: np.ndarray, beside: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without repeated lines and passages, and their byte spans.

    gone: places of repeated units; own: of those that the same row holds above;
    beside: earlier texts, each with the number of the word its first stands beside.
    """
    w0, w1, base = p.word_of[i], p.word_of[i + 1], p.offsets[i]
    gone_words = np.zeros(w1 - w0, np.int8)
    for places, again in ((gone, False), (own, True)):
        for k in (places + p.first_of[i]).tolist():
            a, b = p.a[k], p.b[k]
            if p.whole[k] and (not again or b - a >= MIN_WORDS or p.ends[b - 1] - p.starts[a] >= MIN_BYTES):
                gone_words[a - w0 : b - w0] = 1
    mine = p.word[w0:w1]
    for x in beside:
        if x["passage"] is None:  # this very text, moved
            at, stop = max(x["lo"] - REACH, x["moved"]), min(x["hi"] + REACH, w1 - w0)
            other = mine[at - x["moved"] : stop - x["moved"]]
        else:
            at, other = x["at"], _words(x["passage"].encode())[2]
        s, e = max(at, 0), min(at + len(other), w1 - w0)
        for a, b in _runs((mine[s:e] == other[s - at : e - at]).astype(np.int8)) if e > s else ():
            a, b = a + s, b + s
            breaks = np.flatnonzero(p.head[w0 + a + 1 : w0 + b]) + a + 1
            if len(breaks) and breaks[0] - a < CHANCE and not p.head[w0 + a]:
                a = breaks[0]
            if len(breaks) and b - breaks[-1] < CHANCE and w0 + b < w1 and not p.head[w0 + b]:
                b = breaks[-1]
            if b - a >= MIN_WORDS:
                gone_words[a:b] = 1
    spans = []
    for s, e in _runs(gone_words):
        s, e = s + w0, e + w0
        # up to the next word, so that the blank or line end behind the run goes too
        stop = p.starts[e] - base if e < w1 else len(text)
        if e < w1 and p.head[e] and not p.head[s]:
            stop = p.ends[e - 1] - base  # the line's beginning stays, and so does its end
        spans.append((int(p.starts[s] - base), int(stop)))
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]]), spans


def dedup(docs: DataFrame) -> DataFrame:
    """Each row of docs with doc_id, text (what is left), n_removed (code points) and removed (spans of the original text)."""
    return _deduped(_numbered(docs)).drop("n")


def _passages(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src, lo, hi, times, passage, lead): words lo - REACH to hi + REACH of the row src; lead: how many of them stand before lo; times as in wanted."""

    names, kinds = ["src", "lo", "hi", "times", "passage", "lead"], (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32())

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for part in common.slices(batches, "text", SLICE_BYTES):
            for n, text, ranges in zip(part.column(0).to_pylist(), common.utf8(part, "text"), part.column(2).to_pylist()):
                starts, ends = common.word_spans(np.frombuffer(text, np.uint8), _WORD)
                for x in ranges:
                    a, b = max(x["lo"] - REACH, 0), min(x["hi"] + REACH, len(starts))
                    out.append((n, x["lo"], x["hi"], x["times"], text[starts[a] : ends[b - 1]].decode(), x["lo"] - a))
                    size += int(ends[b - 1] - starts[a])
                    if size >= SLICE_BYTES:  # passages of one text overlap: together they may be far longer
                        yield made(out)
                        out, size = [], 0
        if out:
            yield made(out)
        common.release()

    ranges = wanted.groupBy("src").agg(F.collect_list(F.struct("lo", "hi", "times")).alias("ranges"))
    held = rows.join(ranges.withColumnRenamed("src", "n"), "n").select("n", "text", "ranges")
    return held.mapInArrow(run, "src long, lo int, hi int, times long, passage string, lead int")


def _deduped(rows: DataFrame) -> DataFrame:
    found = common.stage(pieces(rows), "pieces")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n", "place", "word")
    repeated = found.groupBy("h").agg(F.count("*").alias("times"), F.min(rank).alias("first")).where("times > 1")
    later = common.join_counted(found, common.stage(repeated, "repeated"), "h").where(~((F.col("first.n") == F.col("n")) & (F.col("first.place") == F.col("place"))))
    later = common.stage(later.select("n", "place", "word", F.col("first.n").alias("src"), F.col("first.word").alias("at")), "later")
    same = F.col("src") == F.col("n")
    gone = later.groupBy("n").agg(F.collect_list(F.when(~same, F.col("place"))).alias("gone"), F.collect_list(F.when(same, F.col("place"))).alias("own"))
    # windows that stand beside one another in two texts are compared together
    runs = later.where("word >= 0").groupBy("n", "src", (F.col("word") - F.col("at")).alias("moved")).agg(F.min("at").alias("lo"), (F.max("at") + MIN_WORDS).cast("int").alias("hi"))
    runs = common.stage(runs, "runs")
    wanted = runs.where(~same).groupBy("src", "lo", "hi").agg(F.count("*").alias("times"))
    passages = common.stage(_passages(rows, wanted), "passages")
    mine = runs.where(same).select("n", "moved", (F.col("lo") + F.col("moved")).alias("lo"), (F.col("hi") + F.col("moved")).alias("hi"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("passage"))
    # a passage that a third of all rows have is met by them in many tasks
    others = common.join_salted(runs.where(~same), passages, ["src", "lo", "hi"]).select("n", "moved", "lo", "hi", (F.col("lo") + F.col("moved") - F.col("lead")).alias("at"), "passage")
    beside = mine.unionByName(others).groupBy("n").agg(F.collect_list(F.struct("moved", "lo", "hi", "at", "passage")).alias("beside"))
    gone = gone.join(beside, "n", "left")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lists, own = common.utf8(batch, "text"), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        beside = batch.column(5)
        valid = batch.column(1).is_valid().to_pylist()
        marked = [i for i, g in enumerate(lists) if g or own[i]]
        p = Pieces([texts[i] for i in marked]) if marked else None
        out, counts, removed = [t if ok else None for t, ok in zip(texts, valid)], [0] * len(texts), [[] for _ in texts]
        for k, i in enumerate(marked):
            out[i], spans = _cut(texts[i], p, k, np.array(lists[i], np.int64), np.array(own[i], np.int64), beside[i].as_py() or [])
            points = np.concatenate([[0], np.cumsum((np.frombuffer(texts[i], np.uint8) & 0xC0) != 0x80)])
            removed[i] = [{"start": int(points[s]), "end": int(points[e])} for s, e in spans]
            counts[i] = sum(x["end"] - x["start"] for x in removed[i])
        left = pa.array([None if t is None else t.decode() for t in out], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), left, pa.array(counts, pa.int64()), pa.array(removed, kind)], ["doc_id", "n", "text", "n_removed", "removed"])

    joined = rows.join(gone, "n", "left").select("doc_id", "text", "n", "gone", "own", "beside")
    return common.over_text(joined, run, "doc_id long, n long, text string, n_removed long, removed array<struct<start: long, end: long>>", limit=SLICE_BYTES)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs, all columns, with text (and n_chars, if there is one) of what is left."""
    plain = common.with_numbers(docs)
    at = {name: common.column_at(docs.columns, name) for name in ("doc_id", "text", "n_chars")}
    if at["text"] is None:
        return docs
    ident = F.lit(None) if at["doc_id"] is None else F.col(f"c{at['doc_id']}")
    rows = plain.select(ident.cast("long").alias("doc_id"), F.col(f"c{at['text']}").cast("string").alias("text"), "n")
    left = _deduped(rows).select("n", F.col("text").alias("left_text"))
    joined = plain.drop(f"c{at['text']}").join(left, "n")
    columns = []
    for i, name in enumerate(docs.columns):
        col = F.col(f"c{i}")
        if i == at["text"]:
            col = F.col("left_text")
        elif i == at["n_chars"]:
            col = F.length("left_text").cast(docs.schema[i].dataType)
        columns.append(col.alias(name))
    return joined.select(*columns)
