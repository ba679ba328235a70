"""Progressive JPEG: exact round trips, the bitwise decoder, the inverse transform."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import jpeg

from .corpus import documents, frame, odd


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=900))
def test_round_trip(payload):
    media = jpeg.encode_payload(payload)
    fast, slow = jpeg.decode_coefficients(media), jpeg.decode_coefficients(media, arrays=False)
    assert jpeg.payload_of(fast) == payload == jpeg.payload_of(slow)
    for a, b in zip(fast.components, slow.components):
        assert (a.blocks == b.blocks).all()


def test_inverse_transform():
    """Against the defining sum."""
    one = jpeg.decode_coefficients(jpeg.encode_payload(bytes(range(192)) + bytes(192)))
    g = np.random.default_rng(3)
    for c in one.components:
        c.blocks[...] = g.integers(-40, 40, c.blocks.shape)
    planes = jpeg.planes(one)
    block, plane = one.components[1].blocks[0, 0], planes[1][:8, :8]
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = block
    f = natural.reshape(8, 8)
    for y in range(8):
        for x in range(8):
            s = sum((2**-0.5 if not u else 1) * (2**-0.5 if not v else 1) * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
            assert abs(min(255, max(0, s + 128)) - int(plane[y, x])) <= 0.51
    assert jpeg.rgb(one).shape == (16, 16, 3) and jpeg.rgb(one).dtype == np.uint8


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


class Writer:
    """Bits of an entropy-coded segment."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def data(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")


def test_a_common_file():
    """A grey file with interleaving restarts, runs, end-of-band runs and both kinds of refinement."""
    g = random.Random(6)
    blocks = np.zeros((2, 3, 64), np.int64)
    for y in range(2):
        for x in range(3):
            blocks[y, x, 0] = g.randrange(-90, 90)
            if (y, x) != (0, 1):
                for k in g.sample(range(1, 64), g.randrange(0, 25)):
                    blocks[y, x, k] = g.choice([-5, -3, -2, -1, 1, 2, 3, 4])
    codes = {s: i for i, s in enumerate(sorted({*range(12), *(r << 4 | s for r in range(16) for s in range(4))}))}
    table = lambda kind: jpeg._segment(0xC4, bytes([kind << 4, *(len(codes) if n == 8 else 0 for n in range(1, 17)), *codes]))

    def symbol(w, s):
        w.put(codes[s], 8)

    def signed(w, v):
        n = abs(v).bit_length()
        w.put(v if v > 0 else v + (1 << n) - 1, n)

    flat = blocks.reshape(-1, 64)
    dc, last = Writer(), 0
    for b in flat:
        v = int(b[0]) >> 1
        symbol(dc, abs(v - last).bit_length())
        signed(dc, v - last)
        last = v
    dc2 = Writer()
    for b in flat:
        dc2.put(int(b[0]) & 1, 1)
    ac, waiting = Writer(), 0

    def end_run(w, waiting, held):
        if waiting:
            n = waiting.bit_length() - 1
            symbol(w, n << 4)
            w.put(waiting - (1 << n), n)
        w.bits += held

    for b in flat:
        run = 0
        values = [int(v / 2) for v in b[1:]]
        if not any(values):
            waiting += 1
            continue
        end_run(ac, waiting, "")
        waiting = 0
        top = max(i for i, v in enumerate(values) if v)
        for v in values[: top + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                symbol(ac, 0xF0)
                run -= 16
            symbol(ac, run << 4 | abs(v).bit_length())
            signed(ac, v)
            run = 0
        waiting = 1 if top < 62 else 0
    end_run(ac, waiting, "")
    fine = Writer()
    for b in flat:
        old = [int(v / 2) for v in b[1:]]
        new = [i for i, v in enumerate(b[1:]) if abs(v) == 1]
        run, held, at = 0, "", 0
        for i in range(63):
            v = int(b[1 + i])
            if old[i]:
                held += str(abs(v) & 1)
            elif v:
                symbol(fine, run << 4 | 1)
                fine.put(int(v > 0), 1)
                fine.bits += held
                run, held, at = 0, "", i + 1
            else:
                run += 1
                if run == 16 and any(j >= i + 1 for j in new):
                    symbol(fine, 0xF0)
                    fine.bits += held
                    run, held, at = 0, "", i + 1
        if at < 63:
            symbol(fine, 0)
            fine.bits += held
    scan = lambda first, last, high, low, w: jpeg._segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])) + w.data()
    media = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0] + [1] * 64)) + jpeg._segment(0xC2, struct.pack(">BHHB", 8, 16, 20, 1) + bytes([1, 0x11, 0])) + table(0) + table(1)
    media += scan(0, 0, 0, 1, dc) + scan(1, 63, 0, 1, ac) + scan(0, 0, 1, 0, dc2) + scan(1, 63, 1, 0, fine) + b"\xff\xd9"
    found = jpeg.decode_coefficients(media)
    assert (found.components[0].blocks == blocks).all()
    assert jpeg.rgb(found).shape == (16, 20, 3)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        jpeg.decode_coefficients(b"GIF89a")


def test_table(spark):
    rows = documents(count=10) + odd()
    docs = frame(spark, rows)
    out = jpeg.read(jpeg.store(docs)).collect()
    expected = {}
    for i, t in rows:
        b = (t or "").encode()
        expected[str(i)] = (len(b), b.ljust(max(1, -(-len(b) // 192)) * 192, b" "))
    assert len(out) == len(rows)
    for r in out:
        n, payload = expected[str(r["doc_id"])]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r["rgb"]) == r["height"] * r["width"] * 3
    assert jpeg.read(jpeg.store(frame(spark, []))).count() == 0
