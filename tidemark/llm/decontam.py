"""Benchmark decontamination by a positional inverted index over the training documents.

The index is partitioned by document. Each segment (a slice of the documents) holds,
for every term, the sorted list of its word positions; segments are written to the
shared folder. A query window is a sequence of terms. Terms are ranked by their
postings over the whole index; a window's matches in a segment come from the list of
its rarest term, moved by the term's offset, and are intersected with the moved lists
of the other terms, rarest first. As every segment answers for its own documents, a
term or a passage that a third of all documents hold is spread like they are, and
nothing is shuffled.

One index serves the whole benchmark: it holds the postings of the benchmark's terms only,
and (without proximity) of those only where they stand in a run of such terms that is long
enough for one of their windows. Above MOST_TERMS distinct terms it holds all postings
instead, with the same answers. The benchmark's windows are then asked for in blocks of
BLOCK_BYTES of text, as arrays, so that what the driver holds and sends is bounded: about
25 bytes a word (measured: 70 MB for a block). In a segment only windows whose rarest term
it holds are looked at, all together.

near() also gives proximity matches: most of a window's terms within a few words of
their places.

Null or empty text has no words: n_words 0, no hit, not contaminated. A benchmark row
with a null item_id hits words but is not listed; with null or empty text it is never
found. Item ids of repeated rows count once. Repeated documents have a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Benchmark text that is asked for at once.
BLOCK_BYTES = 4 << 20
#: Distinct benchmark terms (16 bytes each) that an index is pruned to.
MOST_TERMS = 2_000_000
#: Candidates (a window at a posting of its rarest term) that are intersected together.
CANDIDATES = 1 << 18

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of lower-cased bytes."""
    starts, ends = common.word_spans(data, _INSIDE)
    return starts, common.span_hashes(data, starts, ends)


class Queries:
    """Windows of a block of benchmark items, as arrays.

    terms: the distinct term hashes, sorted; codes: the items' words as places in terms,
    item after item; begin, size and item of each window, which is codes[begin:begin + size].
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW):
        texts = [(t or "").encode() for _, t in items]
        self.names = [i for i, _ in items]
        data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        starts, hashes = words(data)
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64))
        counts = np.diff(first)
        sizes = np.minimum(counts, width)
        windows = np.where(counts > 0, counts - sizes + 1, 0)
        self.item = np.repeat(np.arange(len(items)), windows)
        self.size = np.repeat(sizes, windows)
        self.begin = np.arange(windows.sum()) + np.repeat(first[:-1] - np.cumsum(windows) + windows, windows)
        self.terms, codes = np.unique(hashes, return_inverse=True)
        self.codes = codes.astype(np.int32)
        self.least = np.full(len(self.terms), width)  # the shortest window with the term
        np.minimum.at(self.least, codes, np.repeat(sizes, counts))
        self.counts = np.ones(len(self.terms), np.int64)
        self.width = width

    def plan(self, terms: np.ndarray, counts: np.ndarray) -> None:
        """Sets the postings of the terms over the whole index, and each window's rarest term."""
        self.counts = np.zeros(len(self.terms), np.int64)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == terms if len(self.terms) else np.zeros(0, bool)
        self.counts[at[known]] = counts[known]
        self.rare = np.zeros(len(self.begin), np.int64)  # offset of the rarest term
        for a in range(0, len(self.begin), 1 << 16):
            self.rare[a : a + (1 << 16)] = self._order(np.arange(a, min(a + (1 << 16), len(self.begin))))[:, 0]
        self.rarest = self.codes[self.begin + self.rare]
        self.by_rarest = np.argsort(self.rarest, kind="stable")
        self.sorted_rarest = self.rarest[self.by_rarest]

    def matrix(self, windows: np.ndarray) -> np.ndarray:
        """The codes of some windows, a row each; -1 after a window's end."""
        step = np.arange(self.width)
        at = self.begin[windows][:, None] + step
        return np.where(step < self.size[windows][:, None], self.codes[np.minimum(at, max(0, len(self.codes) - 1))], -1)

    def _order(self, windows: np.ndarray) -> np.ndarray:
        """The offsets of each window's terms, rarest first."""
        codes = self.matrix(windows)
        many = np.where(codes < 0, np.iinfo(np.int64).max, self.counts[codes])
        return np.argsort(many, 1, kind="stable")


_SEGMENT = "n array<long>, doc_id array<long>, n_words array<int>, begin array<long>, terms array<long>, ends array<int>, positions array<int>"


def segment_of(texts: list[bytes], terms: np.ndarray | None, least: np.ndarray | None, gap: int = 1) -> tuple:
    """n_words and first position of each text; then terms, ends of their lists, and positions.

    Positions run through the segment with ``gap`` unused ones between texts. terms: None for all.
    ``least``: keep a posting only in a run of query terms of so many words.
    """
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    starts, hashes = words(data)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    begin = first[:-1] + np.arange(len(texts)) * gap
    position = np.arange(len(starts)) + np.repeat(np.arange(len(texts)) * gap, n_words)
    if terms is None:
        terms, least = np.unique(hashes), None
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    keep = np.flatnonzero(terms[at] == hashes) if len(terms) else np.zeros(0, np.int64)
    if least is not None and len(keep):
        breaks = np.flatnonzero(np.diff(position[keep]) != 1) + 1
        sizes = np.diff(np.concatenate([[0], breaks, [len(keep)]]))
        keep = keep[np.repeat(sizes, sizes) >= least[at[keep]]]
    order = keep[np.argsort(at[keep], kind="stable")]
    kinds, counts = np.unique(at[order], return_counts=True)
    listed = terms[kinds] if len(kinds) else np.zeros(0, np.uint64)
    return n_words, begin, listed.view(np.int64), np.cumsum(counts), position[order]


def index(docs: DataFrame, terms: np.ndarray, least: np.ndarray | None, gap: int = 1) -> DataFrame:
    """The segments of rows (n, doc_id, text), written to the shared folder. terms: sorted; of others there are no postings."""
    held = docs.sparkSession.sparkContext.broadcast((terms, least))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, least = held.value
        n_words, begin, kinds, ends, positions = segment_of(common.utf8(batch, "text"), terms, least, gap)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        columns = [one(batch.column(0), pa.int64()), one(batch.column(1), pa.int64()), one(n_words, pa.int32()), one(begin, pa.int64()), one(kinds, pa.int64()), one(ends, pa.int32()), one(positions, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SEGMENT.split(", ")])

    return common.stage(common.over_text(docs, rows, _SEGMENT), "postings")


def term_counts(segments: DataFrame, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """The block's terms that the whole index holds, and their postings there; as arrays."""
    held = segments.sparkSession.sparkContext.broadcast(queries.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                listed = terms.values.to_numpy()
                wanted = np.isin(listed.view(np.uint64), held.value)
                yield pa.RecordBatch.from_arrays([pa.array(listed[wanted]), pa.array(np.diff(ends.values.to_numpy(), prepend=0).astype(np.int64)[wanted])], ["term", "c"])

    counts = segments.select("terms", "ends").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).toArrow()
    return counts.column("term").to_numpy().view(np.uint64), counts.column("c").to_numpy()


class Lists:
    """The postings of one segment for a block's terms: keys (code and position), sorted."""

    def __init__(self, queries: Queries, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray):
        at = np.searchsorted(queries.terms, terms)
        at[at == len(queries.terms)] = 0
        known = queries.terms[at] == terms if len(queries.terms) else np.zeros(len(terms), bool)
        begins, sizes = np.append(0, ends[:-1])[known], np.diff(ends, prepend=0)[known]
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.codes, self.sizes = at[known], sizes
        self.ends = np.cumsum(sizes)
        self.positions = positions[np.repeat(begins, sizes) + step].astype(np.int64)
        self.span = int(self.positions.max()) + 2 * queries.width if len(self.positions) else 1
        self.keys = np.repeat(self.codes, sizes) * self.span + self.positions

    def of(self, code: int) -> np.ndarray:
        """The positions of a term."""
        i = int(np.searchsorted(self.codes, code))
        if i == len(self.codes) or self.codes[i] != code:
            return np.zeros(0, np.int64)
        return self.positions[self.ends[i] - self.sizes[i] : self.ends[i]]

    def hold(self, codes: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in its term's list."""
        keys = codes * self.span + positions
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == keys) & (positions >= 0) & (positions < self.span)


def phrase_matches(queries: Queries, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all exact matches: the moved list of a window's rarest term, intersected with those of its other terms, rarest first."""
    found = [np.zeros((2, 0), np.int64)]
    low = np.searchsorted(queries.sorted_rarest, lists.codes, "left")
    many = np.searchsorted(queries.sorted_rarest, lists.codes, "right") - low
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    windows = queries.by_rarest[np.repeat(low, many) + step]
    sizes, begins = np.repeat(lists.sizes, many), np.repeat(lists.ends - lists.sizes, many)
    part = np.cumsum(sizes) // CANDIDATES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(windows)]
    for a, b in zip(cuts, cuts[1:]):
        if b <= a:
            continue
        codes, order = queries.matrix(windows[a:b]), queries._order(windows[a:b])
        size = queries.size[windows[a:b]]
        w = np.repeat(np.arange(b - a), sizes[a:b])
        at = np.arange(len(w)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b])
        start = lists.positions[begins[a:b][w] + at] - queries.rare[windows[a:b]][w]
        for k in range(1, queries.width):
            offset = order[w, k]
            keep = (k >= size[w]) | lists.hold(np.maximum(codes[w, offset], 0), start + offset)
            w, start = w[keep], start[keep]
            if not len(w):
                break
        found.append(np.stack([windows[a:b][w], start]))
    return tuple(np.concatenate(found, 1))


def near_spans(lists: list[np.ndarray], slack: int, least: int) -> np.ndarray:
    """(first, stop) of the words of each match: for some start, ``least`` terms or more stand within ``slack`` words of their places.

    lists: of each term in order. Any such match has one of the rarest present terms in it,
    so that starts are tried around these. first and stop enclose the terms that were found.
    """
    rarest = sorted((i for i in range(len(lists)) if len(lists[i])), key=lambda i: len(lists[i]))
    tried = [lists[offset] - offset + d for offset in rarest[: max(0, len(rarest) - least + 1)] for d in range(-slack, slack + 1)]
    if not tried:
        return np.zeros((0, 2), np.int64)
    starts = np.unique(np.concatenate(tried))
    found = np.zeros(len(starts), np.int64)
    first, stop = np.full(len(starts), np.iinfo(np.int64).max), np.zeros(len(starts), np.int64)
    for offset in rarest:
        listed, want = lists[offset], starts + offset
        a, b = np.searchsorted(listed, want - slack, "left"), np.searchsorted(listed, want + slack, "right")
        has = np.flatnonzero(a < b)
        found[has] += 1
        first[has] = np.minimum(first[has], listed[a[has]])
        stop[has] = np.maximum(stop[has], listed[b[has] - 1] + 1)
    matched = found >= least
    return np.unique(np.stack([first[matched], stop[matched]], 1), axis=0)


def near_matches(queries: Queries, lists: Lists, slack: int, missing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first, stop) of all proximity matches; only windows of which all but ``missing`` terms are in the segment are looked at."""
    present = np.zeros(len(queries.terms) + 1, bool)
    present[lists.codes] = True
    found = [np.zeros((3, 0), np.int64)]
    for a in range(0, len(queries.begin), 1 << 16):
        some = np.arange(a, min(a + (1 << 16), len(queries.begin)))
        enough = present[queries.matrix(some)].sum(1) >= np.maximum(1, queries.size[some] - missing)
        for w in some[enough].tolist():
            size = int(queries.size[w])
            spans = near_spans([lists.of(c) for c in queries.codes[queries.begin[w] :][:size]], slack, max(1, size - missing))
            found.append(np.stack([np.full(len(spans), w), *spans.T]))
    return tuple(np.concatenate(found, 1))


_FOUND = "n long, doc_id long, n_words int, hits array<int>, items array<string>"


def search(segments: DataFrame, queries: Queries, slack: int = 0, missing: int = 0) -> DataFrame:
    """For each document: the words (numbers from 0) in any match of a window, and the items matched.

    slack or missing: proximity instead of exact matches; the index must not be pruned by runs then.
    """
    queries.plan(*term_counts(segments, queries))
    held = segments.sparkSession.sparkContext.broadcast(queries)
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                n, ids, n_words, begin, terms, ends, positions = (batch.column(i)[k].values for i in range(7))
                lists = Lists(asked, terms.to_numpy().view(np.uint64), ends.to_numpy(), positions.to_numpy())
                if slack or missing:
                    windows, starts, stops = near_matches(asked, lists, slack, missing)
                else:
                    windows, starts = phrase_matches(asked, lists)
                    stops = starts + asked.size[windows]
                first, sizes = begin.to_numpy(), n_words.to_numpy()
                end = int(first[-1] + sizes[-1]) if len(first) else 0
                doc = np.searchsorted(first, starts, "right") - 1
                edge = np.zeros(end + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, stops, -1)
                hit = np.flatnonzero(np.cumsum(edge) > 0)
                owner = np.searchsorted(first, hit, "right") - 1
                words_of = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(first) + 1)), pa.int32()), pa.array(hit - first[owner], pa.int32()))
                items: dict[int, set] = {}
                for d, i in set(zip(doc.tolist(), asked.item[windows].tolist())):
                    if asked.names[i] is not None:
                        items.setdefault(d, set()).add(asked.names[i])
                item_rows = [sorted(items.get(d, ())) for d in range(len(n))]
                yield pa.RecordBatch.from_arrays([n, ids, n_words, words_of, pa.array(item_rows, kinds[4])], names)

    return segments.mapInArrow(run, _FOUND)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's items, BLOCK_BYTES of text at a time."""
    rows = common.pick(benchmark, item_id="string", text="string")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(max(1, blocks)):
        part = rows if blocks <= 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks)).between(2 * b, 2 * b + 1))
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def vocabulary(blocks: Iterator[Queries]) -> tuple[np.ndarray, np.ndarray] | None:
    """The terms of all blocks, sorted, and the shortest window of each; None above MOST_TERMS."""
    terms, least = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for block in blocks:
        both, low = np.concatenate([terms, block.terms]), np.concatenate([least, block.least])
        terms, at = np.unique(both, return_inverse=True)
        if len(terms) > MOST_TERMS:
            return None
        least = np.full(len(terms), WINDOW)
        np.minimum.at(least, at, low)
    return terms, least


def numbered(docs: DataFrame) -> DataFrame:
    """n, doc_id and text of each row."""
    return common.numbered(docs, doc_id="long", text="string").select("n", "doc_id", "text")


def matches(rows: DataFrame, benchmark: DataFrame, slack: int = 0, missing: int = 0) -> DataFrame:
    """search() of all blocks of the benchmark: one row for each of ``rows``, which are read once."""
    wanted = vocabulary(Queries(block) for block in _blocks(benchmark))
    terms, least = wanted or (None, None)
    # a proximity match doesn't reach from one text into the next
    segments = index(rows, terms, None, WINDOW + 2 * slack) if slack or missing else index(rows, terms, least)
    found = [search(segments, Queries(block), slack, missing) for block in _blocks(benchmark)]
    if len(found) == 1:
        return found[0]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    grouped = whole.groupBy("n").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    return grouped.select("n", "doc_id", "n_words", F.array_distinct(F.flatten("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def near(docs: DataFrame, benchmark: DataFrame, slack: int = 3, missing: int = 2) -> DataFrame:
    """doc_id, n_words, hits and items of proximity matches: all but ``missing`` terms of a window (one at least) stand
    within ``slack`` words of their places, for some place of the window, which may begin before the text or end
    behind it. hits: from the first of these terms to the last.
    """
    return matches(numbered(docs), benchmark, slack, missing).drop("n")


def _verdicts(found: DataFrame) -> DataFrame:
    n_hit, n_words = F.size("hits").cast("long"), F.col("n_words").cast("long")
    return found.select(
        "n",
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    return _verdicts(matches(numbered(docs), benchmark)).drop("n")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated."""
    plain = common.with_numbers(docs)
    text, ident = (common.column_at(docs.columns, name) for name in ("text", "doc_id"))
    column = lambda at, kind: (F.lit(None) if at is None else F.col(f"c{at}")).cast(kind)
    rows = plain.select("n", column(ident, "long").alias("doc_id"), column(text, "string").alias("text"))
    bad = _verdicts(matches(rows, benchmark)).where("contaminated").select("n")
    return plain.join(bad, "n", "left_anti").drop("n").toDF(*docs.columns)
