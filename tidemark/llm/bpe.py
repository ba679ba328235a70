"""Byte-level BPE encoding and decoding with a rank file.

Distinct pieces of a slice of text are sorted into length buckets and padded to
numpy matrices. In each round every row merges its leftmost pair of minimum rank;
ranks of pairs come from an open-addressing hash table held in two arrays; rows
are compacted after each merge and leave the matrix when no pair has a rank.
Pieces over MATRIX_LEN bytes (one row would need rounds times length) merge the
same pairs in the same order through a heap.

Null text is the empty text: no tokens. Texts are taken whole. Rows are kept as
they are, repeated ones too; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

MATRIX_LEN = 1024
#: Distinct pieces that a worker remembers (under 200 bytes each); the memory is emptied beyond that.
MEMORY = 250_000
_NONE = np.int32(2**31 - 1)


class Codec:
    """Encoder and decoder of one rank file; ``pattern`` splits text before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.split = regex.compile(pattern)
        self.ranks = ranks
        self.vocab = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: str(rank).encode() for rank in self.vocab}
        self.single = np.full(256, -1, np.int32)
        for b in range(256):
            self.single[b] = ranks[bytes([b])]
        self._hash_pairs()
        self.memory: dict[bytes, bytes] = {}  # a piece's ids as 32-bit integers

    def _hash_pairs(self) -> None:
        """All (left, right) whose concatenation has a rank, by hashed key."""
        found = []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, rank))
        self.bits = max(4, (len(found) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        keys = np.array([k for k, _ in found], np.int64)
        values = np.array([v for _, v in found], np.int32)
        slots, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            at = slots[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.values[at[placed]] = values[todo[placed]]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it has none or a side is padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), _NONE, np.int32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            at = slots[todo]
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go_on = ~hit & (there != -1)
            todo = todo[go_on]
            if not len(todo):
                break
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of pieces of similar length."""
        n, width = len(pieces), max(map(len, pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[raw]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        out: list = [None] * n
        row = np.arange(n)

        def leave(done: np.ndarray) -> None:
            for r, line in zip(row[done].tolist(), ids[done]):
                out[r] = line[line >= 0]

        while len(row):
            if ids.shape[1] == 1:
                leave(np.ones(len(row), bool))
                break
            at = ranks.argmin(1)  # the leftmost of equal ranks
            here = np.arange(len(row))
            best = ranks[here, at]
            done = best == _NONE
            if done.any():
                leave(done)
                ids, ranks, row, at, best = ids[~done], ranks[~done], row[~done], at[~done], best[~done]
                if not len(row):
                    break
                here = np.arange(len(row))
            ids[here, at] = best
            source = np.arange(ids.shape[1] - 1)[None, :]
            source = source + (source > at[:, None])
            last = ids[:, -1:]
            moved = np.take_along_axis(ids, source, 1)
            tail = at == ids.shape[1] - 1
            ids = moved
            if tail.any():  # not reached: a pair's left side is never the last column
                ids[tail, -1] = last[tail, 0]
            if ids.shape[1] == 1:
                continue
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], ranks.shape[1] - 1), 1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < ids.shape[1] - 1)
                ranks[here[ok], side[ok]] = self.pair_ranks(ids[here[ok], side[ok]], ids[here[ok], side[ok] + 1])
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
        vocab, ranks = self.vocab, self.ranks

        def rank(i: int):
            j = ahead[i]
            return ranks.get(vocab[ids[i]] + vocab[ids[j]]) if j < n else None

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = r, -1
            ahead[i] = ahead[j]
            if ahead[i] < n:
                back[ahead[i]] = i
            for k in (back[i], i):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k, ids[k], ids[ahead[k]]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece, by length buckets."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            n = len(piece)
            buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            if width > MATRIX_LEN:
                for i in members:
                    out[i] = self._heap(pieces[i])
                continue
            step = max(1, (1 << 18) // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def remember(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """piece -> its ids (32-bit integers), holding at least these; new ones are encoded together."""
        memory = self.memory
        new = list(pieces.difference(memory))
        if len(memory) + len(new) > MEMORY:
            memory.clear()
            new = list(pieces)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            memory.update(zip(part, [ids.tobytes() for ids in self.encode_pieces(part)]))
        return memory

    def encode(self, text: str) -> list[int]:
        """Token ids of a text, without special tokens."""
        pieces = split_bytes(text.encode(), self.split)
        memory = self.remember(set(pieces))
        return np.frombuffer(b"".join([memory[p] for p in pieces]), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.vocab.__getitem__, ids))


#: Classes of code points as the split pattern sees them.
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def _class_table() -> np.ndarray:
    """The class of each code point, asked of the same regex module that splits."""
    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    codes = np.frombuffer(everything.encode("utf-32-le"), np.uint32)
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            out[codes[m.start() : m.end()]] = kind
    return out


_table: list = []


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Start offsets of the pieces of a text without apostrophes, given its code points.

    Runs of letters, numbers and other signs each take one blank before them; a
    run of white space before something else leaves its last character over.
    """
    if not _table:
        _table.append(_class_table())
    kind = _table[0][codes]
    n = len(codes)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    space = kind == _SPACE
    follows = np.zeros(n, bool)  # white space right before something else
    follows[:-1] = space[:-1] & ~space[1:]
    start |= follows
    glued = np.flatnonzero(follows & (codes == 32)) + 1
    start[glued] = False
    return np.flatnonzero(start)


def split_bytes(raw: bytes, pattern: regex.Pattern) -> list[bytes]:
    """The pieces of a UTF-8 text, as the pattern gives them.

    The vectorised path knows the pattern's alternatives but for contractions, so
    texts with an apostrophe take the pattern itself.
    """
    if not raw:
        return []
    if b"'" in raw:
        return [p.encode() for p in pattern.findall(raw.decode())]
    data = np.frombuffer(raw, np.uint8)
    if raw.isascii():
        at = boundaries(data)
    else:
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)[boundaries(codes)]
    cuts = at.tolist()
    cuts.append(len(raw))
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in each process."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
    return _codecs[key]


def tokenizer_file(name: str) -> str:
    """The place of a public rank file on this machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def encode(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of each row of docs.

    The rank file is looked up by name where a task runs, so that no path of the
    driver is needed there. Decoding starts from the ids.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        import public_tokenizers

        c = codec(tokenizer_file(name), public_tokenizers.PATTERN)
        n, ids_sha, text_sha, lists = [], [], [], []
        texts = [split_bytes(raw, c.split) for raw in common.utf8(batch, "text")]
        memory = c.remember(set(chain.from_iterable(texts)))
        for pieces in texts:
            raw = b"".join([memory[p] for p in pieces])
            ids = np.frombuffer(raw, np.int32).tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(b",".join(map(c.digits.__getitem__, ids))).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            if keep_ids:
                lists.append(raw)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            flat = pa.array(np.frombuffer(b"".join(lists), np.int32))
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int32)), flat))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return common.over_text(common.pick(docs, doc_id="long", text="string"), rows, schema)
