"""Removal of byte strings that occur more than once, by a hash-compared suffix sort.

Every byte covered by a LENGTH-byte string that also starts anywhere else goes, the
first occurrence too; strings are judged on the input.

Which suffixes can matter: the anchor of a LENGTH-byte window is the least hash among
its GRAM-byte strings (the leftmost of equal ones), so equal windows have equal
anchors at equal distances. A document's windows fall into runs with one anchor; run
and anchor have a context, the bytes that the run's windows cover.

1. Anchors whose hash occurs once are done: their windows are unique. Where all
   contexts of an anchor hash are equal, or a context occurs twice, all windows of it
   are repeated. Contexts are compared by 128-bit BLAKE2b digests of their bytes, which
   takes the place of comparing the bytes of thousands of copies; this needs counts
   only, so that copies are pre-aggregated. A hash that many anchors share is joined
   where its rows are (common.join_counted).
2. For the rest, one representative of each distinct context goes with its bytes to
   the task of its anchor hash. There the suffixes from the anchor on, and the reversed
   prefixes before it, are sorted by a mergesort that compares two suffixes by the
   length of their common extension, found by binary search over prefix polynomial
   hashes. The common extension of neighbours is verified byte by byte; a collision
   changes the polynomial and sorts again. A window at distance d before its anchor is
   repeated where another context shares d bytes to the left and LENGTH - d to the right.
3. An anchor hash with more than GROUP distinct contexts would not fit a task. Its
   windows are counted by their digests, like the contexts, instead: the same answer.

Null or empty text has no bytes, nothing removed. Documents under LENGTH bytes stay
whole. Rows are documents of their own, repeated ones repeat each other; a null doc_id
stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
GRAM = 160
#: Contexts of one anchor hash that are sorted in one task.
GROUP = 20_000
#: Contexts that are sorted together (whole groups).
TOGETHER = 12_000
#: Windows whose anchors are looked for together.
CHUNK = 1 << 20
_POSITION_BITS = 22


def _tables(seed: int) -> np.ndarray:
    """A 64-bit value for each byte."""
    return common.mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32))


_ONE = _tables(1)


class Prefixes:
    """Hashes of any span of data in constant time."""

    def __init__(self, data: np.ndarray, table: np.ndarray):
        up, self.down = common.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def span(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts data[offsets[i]:offsets[i+1]].

    Returns text number, first window, last window, anchor (offsets in data), the
    anchor's hash and the two halves of the BLAKE2b digest of the run's context.
    """
    windows = len(data) - length + 1
    if windows <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    whole = np.diff(offsets)
    valid = np.zeros(windows + 1, np.int8)
    for a, n in zip(offsets[:-1][whole >= length].tolist(), whole[whole >= length].tolist()):
        valid[a : a + n - length + 1] = 1
    at = np.empty(windows, np.int64)
    for c in range(0, windows, CHUNK):
        part = data[c : c + CHUNK + length - 1]
        grams = common.mix(Prefixes(part, _ONE).span(np.arange(len(part) - gram + 1), gram))
        packed = grams >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_least(packed, length - gram + 1)
        at[c : c + len(least)] = (least & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64) + c
    begin = valid[:-1] == 1
    begin[1:] &= (at[1:] != at[:-1]) | (valid[:-2] == 0)
    first = np.flatnonzero(begin)
    end = valid[:-1] == 1
    end[:-1] &= (at[1:] != at[:-1]) | (valid[1:-1] == 0)
    last = np.flatnonzero(end)
    anchor = at[first]
    text = np.searchsorted(offsets, first, "right") - 1
    one = Prefixes(data, _ONE)
    c, c2 = digests(data, first, last + length)
    return text, first, last, anchor, common.mix(one.span(anchor, np.full(len(anchor), gram))).view(np.int64), c, c2


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 128-bit BLAKE2b digest of data[start:end] for each span, as two rows of longs: equal digests stand for equal bytes."""
    raw, make = data.tobytes(), hashlib.blake2b
    out = b"".join([make(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(out, np.int64).reshape(-1, 2).T.copy()


_ANCHORS = "h long, c long, c2 long, n long, at long, low int, high int"


def _anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """h, c, c2 (hashes of the anchor and its context), n, at (the anchor), and the distances low..high of its windows before it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.utf8(batch, "text")
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        text, first, last, anchor, h, c, c2 = anchors(np.frombuffer(b"".join(texts), np.uint8), offsets, length, gram)
        columns = [h, c, c2, np.asarray(batch.column(0))[text], anchor - offsets[text], (anchor - last).astype(np.int32), (anchor - first).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in _ANCHORS.split(", ")])

    return common.over_text(rows.select("n", "text"), run, _ANCHORS)


class Suffixes:
    """Byte suffixes of one array, each with a length, that are compared within groups."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.data, self.start, self.size, self.group = data, start, size, group
        self.seed = 3
        self.prefixes = Prefixes(data, _tables(self.seed))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, by binary search over prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.start[i], self.start[j]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) >> 1
            same = self.prefixes.span(a, middle) == self.prefixes.span(b, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j (a prefix before what it begins)."""
        n = self.common(i, j)
        inner = n < np.minimum(self.size[i], self.size[j])
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.start[i] + n, last)], self.data[np.minimum(self.start[j] + n, last)]
        return np.where(inner, x < y, self.size[i] < self.size[j])

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order within their groups (which are contiguous), and the common extension of each with the next (-1 at a group's end)."""
        while True:
            found, shared = self._sorted()
            if self._verified(found, shared):
                return found, shared
            self.seed += 1
            self.prefixes = Prefixes(self.data, _tables(self.seed))

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.start)
        order = np.arange(n)
        edges = np.flatnonzero(np.diff(self.group, prepend=self.group[0] - 1 if n else 0))
        sizes = np.diff(np.append(edges, n))
        base, length = np.repeat(edges, sizes), np.repeat(sizes, sizes)
        place = np.arange(n) - base
        width = 1
        while width < (sizes.max() if n else 0):
            run = place // width
            left = run % 2 == 0
            sibling = np.where(left, run + 1, run - 1) * width
            low = np.minimum(sibling, length)
            high = np.minimum(sibling + width, length)
            begin = low.copy()
            while True:  # how many of the sibling run come before each suffix
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    break
                middle = (low[todo] + high[todo]) >> 1
                other, own = order[base[todo] + middle], order[todo]
                # the left run's suffixes come first among equals
                before = np.where(left[todo], self.less(other, own), ~self.less(own, other))
                low[todo] = np.where(before, middle + 1, low[todo])
                high[todo] = np.where(before, high[todo], middle)
            pair = (run // 2) * 2 * width
            target = base + pair + (place - run * width) + (low - begin)
            merged = np.empty(n, np.int64)
            merged[target] = order
            order = merged
            width *= 2
        shared = np.full(n, -1, np.int64)
        inner = np.flatnonzero(self.group[:-1] == self.group[1:]) if n > 1 else np.zeros(0, np.int64)
        shared[inner] = self.common(order[inner], order[inner + 1])
        return order, shared

    def _verified(self, order: np.ndarray, shared: np.ndarray) -> bool:
        """Whether all common extensions hold byte by byte."""
        at = np.flatnonzero(shared > 0)
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096]
            n = shared[part]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = np.repeat(self.start[order[part]], n), np.repeat(self.start[order[part + 1]], n)
            if (self.data[a + step] != self.data[b + step]).any():
                return False
        return True


def repeated(contexts: list[bytes], group: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """For each context, the distances d (columns, from 0) at which its window occurs in another context of its group.

    left: bytes before the anchor; low..high: the distances of the context's windows.
    """
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    end = np.cumsum(size)
    start = end - size
    data = np.frombuffer(b"".join(contexts), np.uint8)
    n = len(contexts)
    right, right_shared = Suffixes(data, start + left, size - left, group).order()
    back, back_shared = Suffixes(data[::-1], len(data) - (start + left), left, group).order()
    out = np.zeros((n, int(high.max()) + 1), bool)
    label_right, label_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(low.min()), int(high.max()) + 1):
        active = np.flatnonzero((low <= d) & (d <= high))
        if len(active) < 2:
            continue
        label_right[right] = np.cumsum(np.append(0, right_shared[:-1] < length - d))
        label_left[back] = np.cumsum(np.append(0, back_shared[:-1] < d))
        key = label_right[active] * n + label_left[active]
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        twice = np.append(False, same) | np.append(same, False)
        out[active[order[twice]], d] = True
    return out


def _spans(hit: np.ndarray, n: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Byte spans of runs of repeated windows: columns are distances before the anchor."""
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return pa.RecordBatch.from_arrays([pa.array(n[row]), pa.array(at[row] - last), pa.array(at[row] - first + length)], ["n", "start", "end"])


_SPANS = "n long, start long, end long"


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the windows that contexts with one anchor hash share; only those with ``alone`` are answered for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def answer(rows: list[dict]) -> pa.RecordBatch:
            column = lambda name: np.array([r[name] for r in rows], np.int64)
            hit = repeated([r["context"] for r in rows], column("h"), column("high"), column("low"), column("high"), length)
            hit[~np.array([r["alone"] for r in rows])] = False
            return _spans(hit, column("n"), column("at"), length)

        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                held += batch.slice(k, 2000).to_pylist()
                while len(held) > TOGETHER:
                    cut = TOGETHER  # where a group begins, at or before it, else after it
                    while cut and held[cut]["h"] == held[cut - 1]["h"]:
                        cut -= 1
                    if not cut:
                        break  # one group fills it: GROUP rows at most, wait for its end
                    yield answer(held[:cut])
                    del held[:cut]
        if held:
            yield answer(held)

    return contexts.select("h", "n", "at", "low", "high", "alone", "context").mapInArrow(run, _SPANS)


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: windows are hashed and counted, then looked up."""
    schema = "w long, w2 long, n long, at long, d int"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pylist()
        data = np.frombuffer(b"".join(r["context"] for r in rows), np.uint8)
        sizes = np.array([len(r["context"]) for r in rows], np.int64)
        counts = sizes - length + 1
        base = np.repeat(np.cumsum(sizes) - sizes, counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        d = np.repeat(np.array([r["high"] for r in rows], np.int64), counts) - step
        take = lambda name: np.repeat(np.array([r[name] for r in rows], np.int64), counts)
        w, w2 = digests(data, base + step, base + step + length)
        columns = [w, w2, take("n"), take("at"), d.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in schema.split(", ")])

    windows = common.over_text(contexts, run, schema, column="context", limit=1 << 18)
    twice = windows.groupBy("w", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w", "w2")
    return windows.join(twice, ["w", "w2"]).select("n", (F.col("at") - F.col("d")).alias("start"), (F.col("at") - F.col("d") + length).alias("end"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int | None = None) -> DataFrame:
    """(n, start, end): byte spans of rows (n, text) that strings of ``length`` bytes which occur elsewhere cover; spans may overlap."""
    group = GROUP if group is None else group
    found = common.stage(_anchor_rows(rows, length, gram), "anchors")
    kind = ("c", "c2", "low", "high")
    hashes = found.groupBy("h").agg(F.count("*").alias("times"), (F.min(F.struct(*kind)) != F.max(F.struct(*kind))).alias("mixed")).where("times > 1")
    shared = common.stage(common.join_counted(found, common.stage(hashes, "anchor-hashes"), "h"), "shared-anchors")
    span = ("n", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))
    copies = shared.where(~F.col("mixed")).select(*span)
    mixed = shared.where("mixed")
    kinds = common.stage(mixed.groupBy("h", *kind).agg(F.count("*").alias("times"), F.min(F.struct("n", "at")).alias("one")), "contexts")
    more = common.join_counted(mixed, kinds.where("times > 1").select("h", *kind, "times"), ["h", *kind]).select(*span)
    large = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > group).select("h", F.lit(True).alias("large"))
    wanted = kinds.join(large, "h", "left").select("h", "one.*", "low", "high", (F.col("times") == 1).alias("alone"), F.coalesce("large", F.lit(False)).alias("large"))
    # the bytes of each wanted context, cut from its text
    lists = wanted.groupBy("n").agg(F.collect_list(F.struct("h", "at", "low", "high", "alone", "large")).alias("wanted"))
    binary = F.encode("text", "UTF-8")
    cut = rows.select("n", binary.alias("b")).join(lists, "n").select("n", "b", F.explode("wanted").alias("x"))
    begin = F.col("x.at") - F.col("x.high")
    contexts = cut.select("x.*", "n", F.substring("b", begin.cast("int") + 1, (F.col("x.high") - F.col("x.low") + length).cast("int")).alias("context"))
    contexts = common.stage(contexts, "context-bytes")
    small = contexts.where(~F.col("large")).repartition("h").sortWithinPartitions("h")
    spans = copies.unionByName(more).unionByName(_compared(small, length))
    if contexts.where("large").limit(1).count():
        spans = spans.unionByName(_counted(contexts.where("large"), length))
    return spans


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int | None = None, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row and, if asked for, kept (the remaining bytes) and removed (byte spans)."""
    rows = common.numbered(docs, doc_id="long", text="string")
    spans = repeated_spans(rows.select("n", F.coalesce("text", F.lit("")).alias("text")), length, gram, group)
    lists = spans.groupBy("n").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<struct<start: long, end: long>>" * keep_bytes
    names = [x.split()[0] for x in schema.replace(" long, end:", " long; end:").split(", ")]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), kind]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for text, found in zip(common.utf8(batch, "text"), batch.column(2).to_pylist()):
            gone = merge([(s["start"], s["end"]) for s in found or ()])
            parts, at = [], 0
            for a, b in gone:
                parts.append(text[at:a])
                at = b
            kept = b"".join([*parts, text[at:]])
            values = (len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in gone])
            for column, v in zip(out, values if keep_bytes else values[:4]):
                column.append(v)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out[: len(names) - 1], kinds))], names)

    joined = rows.join(lists, "n", "left").select("doc_id", "text", "spans")
    return common.over_text(joined, run, schema)
