"""Media columns: progressive JPEG files in a binary column, and their decoder in numpy.

decode_coefficients() accumulates spectral-selection and successive-approximation
scans into one coefficient array per component; rgb() inverse-transforms them,
upsamples chroma and gives the full-resolution RGB tensor.

Storing bytes without loss: an 8-bit RGB sample does not survive a JPEG's rounding,
so the unit that holds a payload byte is the format's own, the quantised
coefficient. Byte b becomes the coefficient b (b >= 128) or b - 255 (b < 128): all
of magnitude 128..255, so each AC coefficient has the same Huffman symbol in its
first scan and one correction bit in its second. The files are ordinary progressive
JPEGs (4:2:0, DC scans with restarts, AC bands 1-5 and 6-63 at point transform 1,
then one AC refinement); scans with a one-symbol table decode as arrays, any other
scan through the bitwise decoder.

Null or empty text is a payload of 192 blanks. Rows are kept as they are, repeated
ones too; equal texts have equal files and features. A null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

UNIT = 192
MCU = 384  # four luma blocks and two of chroma, 64 coefficients each


def _zigzag() -> np.ndarray:
    """Natural index of the k-th coefficient in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_K, _X = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
#: DCT[k, x]: the orthonormal 8-point cosine basis.
DCT = (np.cos((2 * _X + 1) * _K * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, symbol: int, length: int) -> bytes:
    """A DHT segment with one symbol, whose code is ``length`` zeros."""
    return _segment(0xC4, bytes([kind << 4 | slot, *(int(i + 1 == length) for i in range(16)), symbol]))


def _scan(component: int, slot: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, slot << 4 | slot, first, last, high << 4 | low])) + data


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold the payload (of at least one byte)."""
    mcus = -(-len(payload) // MCU)
    wide = int(np.ceil(np.sqrt(mcus)))
    high = -(-mcus // wide)
    data = np.full(wide * high * MCU, 32, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    mcu = data.reshape(high, wide, 6, 64)
    luma = mcu[:, :, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    blocks = (luma, mcu[:, :, 4].reshape(-1, 64), mcu[:, :, 5].reshape(-1, 64))
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        _segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0, 0, 8, 8),
        _table(1, 0, 7, 1),
        _segment(0xDD, struct.pack(">H", 1)),
    ]
    for i, b in enumerate(blocks):
        rows = np.empty((len(b), 4), np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = 0, b[:, 0], 0xFF
        rows[:, 3] = 0xD0 + np.arange(len(b)) % 8
        if (b[:, 0] == 0xFF).any():
            dc = b"".join(b"\0\xff\0" + r[2:].tobytes() if r[1] == 0xFF else r.tobytes() for r in rows)
        else:
            dc = rows.tobytes()
        out.append(_scan(i + 1, 0, 0, 0, 0, 0, dc[:-2]))
    out.append(_segment(0xDD, struct.pack(">H", 0)))
    for first, last in ((1, 5), (6, 63)):
        out += [_scan(i + 1, 0, first, last, 0, 1, (b[:, first : last + 1] >> 1).tobytes()) for i, b in enumerate(blocks)]
    out.append(_table(1, 0, 0, 1))  # end of band
    for i, b in enumerate(blocks):
        bits = b & 1
        bits ^= b < 128
        bits[:, 0] = 0  # the end-of-band code, before 63 correction bits
        out.append(_scan(i + 1, 0, 1, 63, 1, 0, np.packbits(bits, axis=1).tobytes().replace(b"\xff", b"\xff\0")))
    return b"".join(out) + b"\xff\xd9"


class _Bits:
    """The bits of one entropy-coded segment; ones after its end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        i = self.at >> 3
        b = self.data[i] >> (7 - (self.at & 7)) & 1 if i < len(self.data) else 1
        self.at += 1
        return b

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        v = self.bits(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Component:
    """One colour component: sampling, table number and its coefficients in zigzag order."""

    def __init__(self, ident: int, sampling: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, sampling >> 4, sampling & 15, quant

    def size(self, width: int, height: int, h: int, v: int) -> None:
        self.across, self.down = -(-(-(-width * self.h // h)) // 8), -(-(-(-height * self.v // v)) // 8)
        mcus = -(-width // (8 * h)), -(-height // (8 * v))
        self.blocks = np.zeros((mcus[1] * self.v, mcus[0] * self.h, 64), np.int16)


class Jpeg:
    """A decoded file: components, quantisation tables, size and comments."""

    def __init__(self) -> None:
        self.components: list[Component] = []
        self.quant: dict[int, np.ndarray] = {}
        self.comments: list[bytes] = []
        self.width = self.height = self.restart = 0


def decode_coefficients(media: bytes, arrays: bool = True) -> Jpeg:
    """All scans of a progressive JPEG accumulated; ``arrays=False`` decodes bit by bit only."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, tables, at = Jpeg(), {}, 2
    while True:
        while media[at] == 0xFF and media[at + 1] == 0xFF:
            at += 1
        marker = media[at + 1]
        at += 2
        if marker == 0xD9:
            return out
        length = struct.unpack_from(">H", media, at)[0]
        body, at = media[at + 2 : at + length], at + length
        if marker == 0xFE:
            out.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                out.quant[body[0] & 15] = values.astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                tables[body[0]] = _codes(counts, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            out.components = [Component(*body[6 + 3 * i : 9 + 3 * i]) for i in range(n)]
            h, v = max(c.h for c in out.components), max(c.v for c in out.components)
            for c in out.components:
                c.size(out.width, out.height, h, v)
        elif marker == 0xDA:
            end = _scan_end(media, at)
            _one_scan(out, tables, body, media[at:end], arrays)
            at = end
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF:
            raise ValueError("not a progressive JPEG")


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a canonical Huffman table."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


#: A marker other than a restart; data bytes 255 are followed by zero.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _scan_end(media: bytes, at: int) -> int:
    """Where the next marker that is no restart begins."""
    found = _MARKER.search(media, at)
    return found.start() if found else len(media)


def _one_scan(out: Jpeg, tables: dict, head: bytes, data: bytes, arrays: bool) -> None:
    n = head[0]
    parts = [(next(c for c in out.components if c.ident == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    if arrays and n == 1:
        c, slots = parts[0]
        table = tables.get(slots >> 4 if not first else 0x10 | slots & 15, {})
        if len(table) == 1 and _as_arrays(out, c, *next(iter(table.items())), data, first, last, high, low):
            return
    _bitwise(out, tables, parts, data, first, last, high, low)


def _as_arrays(out: Jpeg, c: Component, code: tuple[int, int], symbol: int, data: bytes, first: int, last: int, high: int, low: int) -> bool:
    """A scan of one component whose table has one symbol, all blocks at once; False if it is of another form."""
    length, size = code[0], symbol & 15
    if code[1] or symbol >> 4:
        return False
    target = c.blocks[: c.down, : c.across, first : last + 1]
    n, band = target.shape[0] * target.shape[1], last - first + 1
    if first == 0:  # DC, a restart after every block: no prediction
        each = -(-(length + size) // 8)
        if high or out.restart != 1 or len(data) != n * (each + 2) - 2:
            return False
        rows = np.frombuffer(data + b"\xff\xd0", np.uint8).reshape(n, each + 2)
        if (rows[:, each] != 0xFF).any() or (rows[:, :each] == 0xFF).any():
            return False
        bits = np.unpackbits(rows[:, :each], axis=1)[:, : length + size].reshape(n, 1, length + size)
        values = _values(bits, length, size)
        if values is None:
            return False
        target[...] = (values << low).reshape(target.shape)
        return True
    if out.restart:
        return False
    raw = np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)
    if not high:
        if not size or len(raw) != -(-n * band * (length + size) // 8):
            return False
        if length + size == 8:
            if (raw >> size).any():
                return False
            v = raw.astype(np.int16)
            values = np.where(v >> (size - 1) > 0, v, v - np.int16((1 << size) - 1))
        else:
            values = _values(np.unpackbits(raw)[: n * band * (length + size)].reshape(n, band, length + size), length, size)
            if values is None:
                return False
        target[...] = (values << low if low == 0 else values * np.int16(1 << low)).reshape(target.shape)
        return True
    if symbol or len(raw) != -(-n * (length + band) // 8) or not target.all():
        return False
    bits = np.unpackbits(raw)[: n * (length + band)].reshape(n, length + band)
    if bits[:, :length].any():
        return False
    step = bits[:, length:].reshape(target.shape).astype(np.int16) << low
    target += np.where(target < 0, -step, step)
    return True


def _values(bits: np.ndarray, length: int, size: int) -> np.ndarray | None:
    """Signed values behind zero codes of ``length`` bits."""
    if bits[..., :length].any():
        return None
    v = np.zeros(bits.shape[:-1], np.int16)
    for k in range(size):
        v = v << 1 | bits[..., length + k]
    return np.where(v >> (size - 1) > 0, v, v - np.int16((1 << size) - 1)) if size else v


def _bitwise(out: Jpeg, tables: dict, parts: list, data: bytes, first: int, last: int, high: int, low: int) -> None:
    """Any scan, bit by bit."""
    pieces, start, at = [], 0, data.find(b"\xff")
    while at >= 0:
        if 0xD0 <= data[at + 1 : at + 2][0] <= 0xD7:
            pieces.append(data[start:at])
            start = at + 2
        at = data.find(b"\xff", at + 2)
    pieces.append(data[start:])
    pieces = iter([p.replace(b"\xff\0", b"\xff") for p in pieces])
    if len(parts) == 1:
        c, slots = parts[0]
        units = [[(c, slots, y, x)] for y in range(c.down) for x in range(c.across)]
    else:
        c = parts[0][0]
        down, across = c.blocks.shape[0] // c.v, c.blocks.shape[1] // c.h
        units = [[(c, s, my * c.v + y, mx * c.h + x) for c, s in parts for y in range(c.v) for x in range(c.h)] for my in range(down) for mx in range(across)]
    bits, run, before = _Bits(b""), 0, {}
    for i, unit in enumerate(units):
        if i == 0 or out.restart and i % out.restart == 0:
            bits, run, before = _Bits(next(pieces, b"")), 0, {}
        for c, slots, y, x in unit:
            block = c.blocks[y, x]
            if first == 0:
                if high:
                    block[0] |= bits.bit() << low
                else:
                    before[c.ident] = before.get(c.ident, 0) + bits.signed(bits.symbol(tables[slots >> 4]))
                    block[0] = before[c.ident] << low
            elif high:
                run = _refine(bits, block, tables[0x10 | slots & 15], run, first, last, low)
            else:
                run = _first(bits, block, tables[0x10 | slots & 15], run, first, last, low)


def _first(bits: _Bits, block: np.ndarray, table: dict, run: int, k: int, last: int, low: int) -> int:
    """One block of an AC band's first scan; returns the end-of-band run that is left."""
    if run:
        return run - 1
    while k <= last:
        r, size = divmod(bits.symbol(table), 16)
        if size:
            k += r
            block[k] = bits.signed(size) * (1 << low)
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) + bits.bits(r) - 1
    return 0


def _refine(bits: _Bits, block: np.ndarray, table: dict, run: int, k: int, last: int, low: int) -> int:
    """One block of an AC band's refinement scan; returns the end-of-band run that is left."""

    def correct(i: int) -> None:
        if bits.bit():
            block[i] += (1 << low) if block[i] > 0 else -(1 << low)

    while not run and k <= last:
        r, size = divmod(bits.symbol(table), 16)
        if not size and r < 15:
            run = (1 << r) + bits.bits(r)
            break
        value = ((1 << low) if bits.bit() else -(1 << low)) if size else 0
        while k <= last:
            if block[k]:
                correct(k)
            elif r:
                r -= 1
            else:
                if value:
                    block[k] = value
                k += 1
                break
            k += 1
    if run:
        for i in range(k, last + 1):
            if block[i]:
                correct(i)
        return run - 1
    return 0


def planes(jpeg: Jpeg) -> list[np.ndarray]:
    """The 8-bit samples of each component at its own resolution."""
    out = []
    for c in jpeg.components:
        down, across, _ = c.blocks.shape
        natural = np.zeros((down * across, 64), np.float32)
        natural[:, ZIGZAG] = c.blocks.reshape(-1, 64) * jpeg.quant[c.quant]
        half = (natural.reshape(-1, 8) @ DCT).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8)
        full = (half @ DCT).reshape(down, across, 8, 8)  # [.., x, y]
        samples = np.clip(np.rint(full + np.float32(128)), 0, 255).astype(np.uint8)
        out.append(samples.transpose(0, 3, 1, 2).reshape(down * 8, across * 8))
    return out


def rgb(jpeg: Jpeg) -> np.ndarray:
    """The full-resolution tensor (height, width, 3), 8 bits."""
    h, v = max(c.h for c in jpeg.components), max(c.v for c in jpeg.components)
    full = []
    for c, p in zip(jpeg.components, planes(jpeg)):
        if (h // c.h, v // c.v) != (1, 1):
            p = p.repeat(v // c.v, 0).repeat(h // c.h, 1)
        full.append(p[: jpeg.height, : jpeg.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, 2)
    y = full[0].astype(np.float32)
    cb, cr = full[1].astype(np.float32) - 128, full[2].astype(np.float32) - 128
    out = np.empty((jpeg.height, jpeg.width, 3), np.uint8)
    for i, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[:, :, i] = np.clip(np.rint(plane), 0, 255)
    return out


def payload_of(jpeg: Jpeg) -> bytes:
    """The bytes that encode_payload() put into the coefficients."""
    size = next(int(c.split()[1]) for c in jpeg.comments if c.startswith(b"payload "))
    y, cb, cr = (c.blocks for c in jpeg.components)
    high, wide = cb.shape[:2]
    mcu = np.empty((high, wide, 6, 64), np.int16)
    mcu[:, :, :4] = y.reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(high, wide, 4, 64)
    mcu[:, :, 4], mcu[:, :, 5] = cb, cr
    flat = mcu.reshape(-1)[:size]
    return np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()


def feature(tensor: np.ndarray) -> str:
    """Height, width, the sum of each channel and of the luma differences between neighbours."""
    sums = tensor.reshape(-1, 3).sum(0, dtype=np.int64)
    green = tensor[:, :, 1].astype(np.int16)
    edges = int(np.abs(np.diff(green, axis=1)).sum(dtype=np.int64))
    return f"{tensor.shape[0]}x{tensor.shape[1]}:{sums[0]},{sums[1]},{sums[2]}:{edges}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column: each row's text as the payload of a progressive JPEG."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.utf8(batch, "text")
        media = [encode_payload(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b" ")) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.over_text(common.pick(docs, doc_id="long", text="string"), rows, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame, tensors: bool = True) -> DataFrame:
    """The media column read back: payload digests, features and, if asked for, the RGB tensor with its shape."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", rgb binary, height int, width int" * tensors

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(9)]
        for media in common.utf8(batch, "media"):
            jpeg = decode_coefficients(media)
            payload, tensor = payload_of(jpeg), rgb(jpeg)
            values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(tensor))
            for column, v in zip(out, values):
                column.append(v)
            if tensors:
                for column, v in zip(out[6:], (tensor.tobytes(), tensor.shape[0], tensor.shape[1])):
                    column.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32()][: 9 if tensors else 6]
        names = [part.split()[0] for part in schema.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    return common.over_text(media, rows, schema, column="media")
