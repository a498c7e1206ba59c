"""Progressive JPEG media columns: decode to RGB tensors, and carry payloads in them.

Decoding accumulates the scans of many files at once: every restart interval is a
lane, and all lanes of like scans step through their codes together in numpy.
DC and AC first scans put values at their point transform, refinement scans add
the further bits, into one coefficient array; blocks are then dequantised, inverse
transformed by one exact integer product, chroma is upsampled and the image
returned as a height x width x 3 RGB tensor.

Payloads are stored losslessly in the format's unit, the quantised coefficient:
192 bytes make one 4:2:2 MCU of four blocks, 48 coefficients each, one byte a
coefficient.  The files use spectral selection (1-5, 6-63) and successive
approximation (DC and 1-5), with a restart interval for each MCU.

Null payloads count as empty; payloads are padded with bytes 32 to a positive
multiple of 192 and come back with the padding.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

UNIT, USED = 192, 48
#: Byte that becomes coefficient 0, and the tallest column of MCUs.
CENTRE, TALLEST = 101, 4096
#: Payload bytes that are handled at once.
CHUNK = 1 << 19


def zigzag() -> np.ndarray:
    """Natural index of the i-th coefficient on the zigzag path."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return np.array([8 * y + x for y, x in sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))])


ZIGZAG = zigzag()


def inverse_basis() -> np.ndarray:
    """64 x 64 integers: coefficient (zigzag) to pixel, scaled by 2**13."""
    u, x = np.mgrid[0:8, 0:8]
    one = np.cos((2 * x + 1) * u * np.pi / 16) / 2 * np.where(u == 0, np.sqrt(0.5), 1.0)
    full = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.round(full[ZIGZAG] * (1 << 13))


BASIS = inverse_basis()


# ---- Huffman codes -------------------------------------------------------------------------


def code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Code lengths of at most 16 with one further symbol, so that no code is all ones."""
    floor = sum(weights.values()) / 4096
    heap = [(max(w, floor), i, [s]) for i, (s, w) in enumerate(sorted(weights.items()))]
    heap.append((0.0, len(heap), [-1]))
    heapq.heapify(heap)
    depth: dict[int, int] = defaultdict(int)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    if max(depth.values()) > 16:
        raise ValueError("the weights give codes beyond 16 bits")
    del depth[-1]
    return dict(depth)


class Code:
    """A canonical JPEG code as its DHT body, encoder arrays and a 16-bit look-up."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.body = counts + symbols
        self.value, self.length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        self.look = np.zeros(1 << 16, np.uint16)
        code, at = 0, 0
        for size, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.value[s], self.length[s] = code, size
                self.look[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | s
                code += 1
            code, at = code << 1, at + n

    @classmethod
    def of(cls, weights: dict[int, float]) -> Code:
        lengths = code_lengths(weights)
        ordered = sorted(lengths, key=lambda s: (lengths[s], s))
        return cls(bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)), bytes(ordered))


def _ac_weights() -> dict[int, float]:
    size = {s: w for s, w in enumerate((0, 6, 10, 20, 25, 25, 3, 15, 3, 1, 1))}
    runs = {r << 4 | s: size[s] * 0.3**r for r in range(16) for s in range(1, 11)}
    return runs | {0xF0: 0.1} | {r << 4: 4 * 0.2**r for r in range(15)}


DC_CODE = Code.of({s: 1 + 6 * (4 <= s <= 7) for s in range(12)})
AC_CODE = Code.of(_ac_weights())
REFINE_CODE = Code.of({0x01: 9, 0x00: 20, 0x11: 5, 0x21: 3, 0x31: 2, 0x41: 1.5} | {r << 4 | 1: 0.2 for r in range(5, 16)} | {0xF0: 0.2} | {r << 4: 0.2 for r in range(1, 15)})


# ---- Encoding ------------------------------------------------------------------------------


_LENGTHS = np.array([v.bit_length() for v in range(1 << 11)])


def _bit_length(v: np.ndarray) -> np.ndarray:
    """Bits of numbers from 0 to 2047."""
    return _LENGTHS[v]


def _magnitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def _pack(lane: np.ndarray, code: np.ndarray, bits: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes, each filled up with ones to whole bytes, and where each lane starts; codes come in lane order."""
    total = np.bincount(lane, weights=bits, minlength=lanes).astype(np.int64)
    size = (total + 7) >> 3
    start = np.concatenate([[0], np.cumsum(size)])
    before = np.cumsum(bits) - bits
    first = np.concatenate([[0], np.cumsum(total)])[:-1]
    at = before - first[lane] + 8 * start[lane]
    pad = size * 8 - total
    at, bits = np.concatenate([at, 8 * start[:-1] + total]), np.concatenate([bits, pad])
    code = np.concatenate([code, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)])
    wide = code << (64 - bits - (at & 31)).astype(np.uint64) if len(code) else code
    wide[bits == 0] = 0
    n = (int(start[-1]) + 3) // 4 + 2
    words = np.bincount(at >> 5, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=n)
    words[1:] += np.bincount(at >> 5, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[:-1]
    return words.astype(np.uint64).astype(">u4").view(np.uint8)[: start[-1]], start


def _framed(data: np.ndarray, start: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuff zero bytes after 255 and put a restart marker before each lane whose ``place`` in its scan isn't 0."""
    full = data == 255
    lead = np.where(place > 0, 2, 0)
    lane = np.repeat(np.arange(len(place)), np.diff(start))
    stuffed = np.cumsum(full) - full
    leads = np.cumsum(lead)
    at = np.arange(len(data)) + stuffed + leads[lane]
    grown = np.concatenate([[0], np.cumsum(full)])
    begin = start + grown[start] + np.concatenate([[0], leads])
    out = np.zeros(int(begin[-1]), np.uint8)
    out[at] = data
    marks = np.flatnonzero(place > 0)
    out[begin[:-1][marks]] = 255
    out[begin[:-1][marks] + 1] = 0xD0 + (place[marks] - 1) % 8
    return out, begin


def _first_tokens(c: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, code, bits) of an AC first scan; c is lanes x band after the point transform."""
    lane, k = np.nonzero(c)
    v = c[lane, k].astype(np.int64)
    same = np.concatenate([[False], lane[1:] == lane[:-1]]) if len(lane) else np.zeros(0, bool)
    run = k - np.where(same, np.concatenate([[0], k[:-1]]) if len(k) else k, -1) - 1
    size = _bit_length(np.abs(v))
    sym = (run & 15) << 4 | size
    value = code.value[sym] << size.astype(np.uint64) | _magnitude(v, size)
    bits = code.length[sym] + size
    long = run >> 4
    if long.any():  # runs of 16 zeros come before their value
        many = np.repeat(np.arange(len(lane)), long + 1)
        own = np.concatenate([many[1:] != many[:-1], [True]])
        lane = lane[many]
        value = np.where(own, value[many], code.value[0xF0])
        bits = np.where(own, bits[many], code.length[0xF0])
    # A lane whose last coefficient is zero ends with an end-of-block code.
    ends = c[:, -1] == 0
    before = np.cumsum(ends) - ends
    at = np.arange(len(lane)) + before[lane]
    close = (np.cumsum(np.bincount(lane, minlength=len(c))) + before)[ends]
    total = len(lane) + len(close)
    lanes, values, widths = np.empty(total, np.int64), np.full(total, code.value[0]), np.full(total, code.length[0])
    lanes[at], values[at], widths[at] = lane, value, bits
    lanes[close] = np.flatnonzero(ends)
    return lanes, values, widths


def _refine_tokens(c: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, code, bits) of a refinement of the last bit over a band of up to 5: at most 64 bits a lane."""
    n = len(c)
    acc, bits = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    held, holds, run = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    size = np.abs(c)

    def put(rows: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
        acc[rows] = acc[rows] << width.astype(np.uint64) | value
        bits[rows] += width
        acc[rows] = acc[rows] << holds[rows].astype(np.uint64) | held[rows]
        bits[rows] += holds[rows]
        held[rows], holds[rows], run[rows] = 0, 0, 0

    for k in range(c.shape[1]):
        old, new = size[:, k] > 1, size[:, k] == 1
        held = np.where(old, held << np.uint64(1) | (size[:, k] & 1).astype(np.uint64), held)
        holds = holds + old
        run = run + (size[:, k] == 0)
        rows = np.flatnonzero(new)
        sym = run[rows] << 4 | 1
        put(rows, code.value[sym] << np.uint64(1) | (c[rows, k] > 0).astype(np.uint64), code.length[sym] + 1)
    rows = np.flatnonzero((run > 0) | (holds > 0))
    put(rows, np.full(len(rows), code.value[0]), np.full(len(rows), code.length[0]))
    lanes = np.flatnonzero(bits)
    return lanes, acc[lanes], bits[lanes]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _scan_header(components: tuple[int, ...], table: int, ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *[x for c in components for x in (c, table)], ss, se, ah << 4 | al]))


_TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + b"".join(_segment(0xC4, bytes([k]) + t.body) for k, t in ((0x00, DC_CODE), (0x10, AC_CODE), (0x11, REFINE_CODE))) + _segment(0xDD, struct.pack(">H", 1))
#: (first coefficient, last, previous and new low bit) of the AC scans; DC has Al = 1 and is refined once.
_AC_SCANS = ((1, 5, 0, 1), (6, 63, 0, 0), (1, 5, 1, 0))


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload (a positive multiple of UNIT bytes)."""
    units = np.array([len(p) // UNIT for p in payloads])
    cols = -(-units // TALLEST)
    rows = -(-units // cols)
    full = rows * cols
    flat = np.frombuffer(b"".join(p + bytes([CENTRE]) * (int(f) * UNIT - len(p)) for p, f in zip(payloads, full, strict=True)), np.uint8)
    mcus = len(flat) // UNIT
    coef = np.zeros((mcus, 4, 64), np.int64)
    coef[:, :, :USED] = ((flat.astype(np.int64) - CENTRE + 128) & 255).reshape(mcus, 4, USED) - 128
    doc_start = np.concatenate([[0], np.cumsum(full)])
    in_doc = np.arange(mcus) - np.repeat(doc_start[:-1], full)
    parts: list[list[bytes]] = [[b"\xff\xd8", _TABLES, _segment(0xC2, struct.pack(">BHHB", 8, 8 * r, 16 * c, 3) + bytes((1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0))), _segment(0xFE, b"payload=%d" % len(p))] for p, r, c in zip(payloads, rows.tolist(), cols.tolist(), strict=True)]

    def emit(header: bytes, data: np.ndarray, begin: np.ndarray, first: np.ndarray) -> None:
        for out, a, b in zip(parts, begin[first[:-1]].tolist(), begin[first[1:]].tolist(), strict=True):
            out += [header, data[a:b].tobytes()]

    # DC, interleaved: an MCU is a lane, and prediction starts anew in each.
    dc = coef[:, :, 0] >> 1
    diff = dc.copy()
    diff[:, 1] -= dc[:, 0]
    size = _bit_length(np.abs(diff)).ravel()
    value = DC_CODE.value[size] << size.astype(np.uint64) | _magnitude(diff.ravel(), size)
    data, begin = _framed(*_pack(np.repeat(np.arange(mcus), 4), value, DC_CODE.length[size] + size, mcus), in_doc)
    emit(_scan_header((1, 2, 3), 0, 0, 0, 0, 1), data, begin, doc_start)
    # In a scan of one component each block is a lane; an MCU has two of luma, side by side.
    component = [coef[:, :2].reshape(-1, 64), coef[:, 2], coef[:, 3]]
    for ss, se, ah, al in _AC_SCANS:
        if ah:
            bit = (coef[:, :, 0] & 1).astype(np.uint64)
            bits = bit[:, 0] << np.uint64(3) | bit[:, 1] << np.uint64(2) | bit[:, 2] << np.uint64(1) | bit[:, 3]
            data, begin = _framed(*_pack(np.arange(mcus), bits, np.full(mcus, 4), mcus), in_doc)
            emit(_scan_header((1, 2, 3), 0, 0, 0, 1, 0), data, begin, doc_start)
        for number, blocks in enumerate(component, 1):
            band = blocks[:, ss : se + 1]
            per = 2 if number == 1 else 1
            place = (np.repeat(in_doc, 2) * 2 + np.tile([0, 1], mcus)) if per == 2 else in_doc
            table, code = (0x01, REFINE_CODE) if ah else (0x00, AC_CODE)
            tokens = _refine_tokens(band, code) if ah else _first_tokens(np.sign(band) * (np.abs(band) >> al), code)
            data, begin = _framed(*_pack(*tokens, len(blocks)), place)
            emit(_scan_header((number,), table, ss, se, ah, al), data, begin, doc_start * per)
    return [b"".join((*p, b"\xff\xd9")) for p in parts]


# ---- Decoding ------------------------------------------------------------------------------


@functools.lru_cache(4096)
def scan_order(width: int, height: int, parts: tuple[tuple[int, int, int], ...], names: tuple[int, ...]) -> tuple[np.ndarray, int, tuple[int, ...]]:
    """Blocks of a scan in coded order (counted from the frame's first), blocks an MCU, and whose component each of these is."""
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    mcus_x, mcus_y = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    first, at = {}, 0
    for c, h, v in parts:
        first[c] = (at, h, v, mcus_x * h)
        at += mcus_x * h * mcus_y * v
    if len(names) == 1:
        begin, h, v, wide = first[names[0]]
        across, down = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
        return (begin + np.arange(down)[:, None] * wide + np.arange(across)).ravel(), 1, (0,)
    grids, owner = [], []
    for k, c in enumerate(names):
        begin, h, v, wide = first[c]
        y, x, b, a = np.ogrid[:mcus_y, :mcus_x, :v, :h]
        grids.append((begin + (y * v + b) * wide + x * h + a).reshape(mcus_y * mcus_x, v * h))
        owner += [k] * (v * h)
    return np.concatenate(grids, 1).ravel(), len(owner), tuple(owner)


class _Image:
    """Frame of one file: sizes, components, and where its coefficients lie in the batch."""

    __slots__ = ("height", "width", "parts", "hmax", "vmax", "mcus_x", "mcus_y", "comment", "base", "quant")


class _Batch:
    """Coefficients and scans of many progressive files."""

    def __init__(self, files: list[bytes]):
        self.raw = np.frombuffer(b"".join(files) + b"\xff\xd9\0\0\0\0\0\0", np.uint8)
        after = self.raw[1:]
        stuffed = np.concatenate([[False], (self.raw[:-1] == 255) & (after == 0)])
        clean = self.raw[~stuffed].astype(np.uint32)
        self.at_clean = np.cumsum(~stuffed) - 1
        tail = np.concatenate([clean, np.zeros(4, np.uint32)])
        self.window = tail[:-4] << np.uint32(24) | tail[1:-3] << np.uint32(16) | tail[2:-2] << np.uint32(8) | tail[3:-1]
        self.marks = np.flatnonzero((self.raw[:-1] == 255) & (after != 0) & (after != 255))
        self.breaks = np.flatnonzero((self.raw[self.marks + 1] & 0xF8) != 0xD0)
        self.codes: list[np.ndarray] = []
        self.code_of: dict[bytes, int] = {}
        self.blocks = 0
        self.jobs: dict[tuple, list] = defaultdict(list)
        self.images: list[_Image] = []
        at = 0
        for f in files:
            self._parse(f, at)
            at += len(f)
        self.coef = np.zeros((self.blocks, 64), np.int64)
        self.look = np.concatenate(self.codes) if self.codes else np.zeros(1, np.uint16)
        # Scans of a file depend on earlier ones; files agree on no order, so scans run by their number.
        for key in sorted(self.jobs):
            self._scan(key, self.jobs[key])

    def _parse(self, f: bytes, base: int) -> None:
        if f[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        image, at, tables, interval, number = _Image(), 2, {}, 0, 0
        image.comment, image.quant = b"", {}
        quant: dict[int, np.ndarray] = {}
        while True:
            if f[at] != 255:
                raise ValueError("a marker is missing")
            marker = f[at + 1]
            if marker == 255:
                at += 1
                continue
            if marker == 0xD9:
                break
            size = f[at + 2] << 8 | f[at + 3]
            body = f[at + 4 : at + 2 + size]
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int64)
                    i += 129 if wide else 65
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    tables[body[i]] = self._code(body[i + 1 : i + 17 + n])
                    i += 17 + n
            elif marker == 0xDD:
                interval = body[0] << 8 | body[1]
            elif marker == 0xFE:
                image.comment = body
            elif marker == 0xC2:
                self._frame(image, body)
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("only progressive Huffman files are read")
            at += 2 + size
            if marker == 0xDA:
                end = self._lanes(image, body, base + at, tables, interval, number)
                at, number = end - base, number + 1
        for _, _, _, q, _, _ in image.parts.values():
            image.quant[q] = quant[q]
        self.images.append(image)

    def _code(self, body: bytes) -> int:
        if body not in self.code_of:
            self.code_of[body] = len(self.codes) << 16
            self.codes.append(Code(body[:16], body[16:]).look)
        return self.code_of[body]

    def _frame(self, image: _Image, body: bytes) -> None:
        precision, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8 or not image.width or not image.height:
            raise ValueError("only 8-bit files with a stated size are read")
        image.parts, image.base = {}, self.blocks
        listed = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        image.hmax, image.vmax = max(x[1] for x in listed), max(x[2] for x in listed)
        image.mcus_x, image.mcus_y = -(-image.width // (8 * image.hmax)), -(-image.height // (8 * image.vmax))
        for c, h, v, q in listed:
            wide = image.mcus_x * h
            image.parts[c] = (self.blocks, h, v, q, wide, image.mcus_y * v)
            self.blocks += wide * image.mcus_y * v

    def _lanes(self, image: _Image, body: bytes, start: int, tables: dict[int, int], interval: int, number: int) -> int:
        """Note the lanes of a scan; returns where its data end."""
        n = body[0]
        names = [body[1 + 2 * i] for i in range(n)]
        table = [body[2 + 2 * i] for i in range(n)]
        ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        i = int(np.searchsorted(self.marks, start))
        j = int(self.breaks[np.searchsorted(self.breaks, i)])
        stops = self.marks[i : j + 1]
        begins = np.concatenate([[start], stops[:-1] + 2])
        order, per, owner = scan_order(image.width, image.height, tuple((c, *p[1:3]) for c, p in image.parts.items()), tuple(names))
        order = order + image.base
        step = (interval or len(order) // per) * per
        if len(begins) != -(-len(order) // step):
            raise ValueError("a scan has other restart intervals than its frame asks for")
        if ss == 0:
            code = np.array([tables.get(table[k] >> 4, 0) for k in owner])
        else:
            code = tables.get(0x10 | (table[0] & 15), 0)
        self.jobs[number, ss, se, ah, al].append((self.at_clean[begins] * 8, self.at_clean[stops] * 8, order, step, per, code, owner))
        return int(stops[-1])

    # -- scans, all lanes together

    def _peek(self, p: np.ndarray) -> np.ndarray:
        return (self.window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(16)

    def _bits(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n (up to 16) bits at each p."""
        return (self._peek(p) >> (16 - n).astype(np.uint32)).astype(np.int64)

    def _scan(self, key: tuple, jobs: list) -> None:
        _, ss, se, ah, al = key
        begin = np.concatenate([j[0] for j in jobs])
        end = np.concatenate([j[1] for j in jobs])
        order = np.concatenate([j[2] for j in jobs])
        first, count = [], []
        at = 0
        for j in jobs:
            n, step = len(j[2]), j[3]
            s = np.arange(0, n, step)
            first.append(at + s)
            count.append(np.minimum(step, n - s))
            at += n
        first, count = np.concatenate(first), np.concatenate(count)
        if ss == 0:
            p = self._dc(jobs, begin, first, count, order, ah, al)
        else:
            code = np.concatenate([np.full(len(j[0]), j[5]) for j in jobs])
            p = (self._ac_refine if ah else self._ac_first)(begin.copy(), first, count, order, code, ss, se, al)
        if (p > end).any():
            raise ValueError("a scan's codes run beyond its data")

    def _dc(self, jobs: list, begin: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray, ah: int, al: int) -> np.ndarray:
        if ah:
            lane = np.repeat(np.arange(len(begin)), count)
            p = begin[lane] + np.arange(len(order)) - first[lane]
            self.coef[order, 0] |= self._bits(p, np.ones(len(p), np.int64)) << al
            return begin + count
        sizes = [len(j[0]) for j in jobs]
        width = max(j[4] for j in jobs)
        code, owner = np.zeros((len(jobs), width), np.int64), np.zeros((len(jobs), width), np.int64)
        for k, j in enumerate(jobs):
            code[k, : j[4]], owner[k, : j[4]] = j[5], j[6]
        per = np.repeat([j[4] for j in jobs], sizes)
        job = np.repeat(np.arange(len(jobs)), sizes)
        p, held = begin.copy(), np.zeros((len(begin), 4), np.int64)
        for t in range(int(count.max())):
            on = np.flatnonzero(count > t) if count.min() <= t else np.arange(len(p))
            spot = t % per[on]
            found = self.look[code[job[on], spot] + self._peek(p[on])]
            size, s = (found >> 8).astype(np.int64), (found & 255).astype(np.int64)
            if not size.all():
                raise ValueError("a code that no table has")
            v = self._bits(p[on] + size, s)
            v = np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v)
            whose = owner[job[on], spot]
            held[on, whose] += v
            self.coef[order[first[on] + t], 0] = held[on, whose] << al
            p[on] += size + s
        return p

    def _ac_first(self, p: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray, code: np.ndarray, ss: int, se: int, al: int) -> np.ndarray:
        done = p.copy()
        block, last, k = first.copy(), first + count, np.full(len(p), ss)
        lane = np.arange(len(p))
        spots, places, sizes = [], [], []
        while len(lane):
            found = self.look[code + self._peek(p)]
            sym = (found & 255).astype(np.int64)
            p = p + (found >> 8)
            run, s = sym >> 4, sym & 15
            has = s > 0
            k = k + np.where(has, run, 0)
            spots.append((order[block] * 64 + np.minimum(k, 63))[has])
            places.append(p[has])
            sizes.append(s[has])
            p = p + s
            skip = ~has & (run == 15)
            k = k + has + 16 * skip
            over = ~has & ~skip
            ended = over | (k > se)
            if over.any():
                extra = np.where(over & (run > 0), (1 << run) - 1 + self._bits(p, np.where(over, run, 0)), 0)
                p = p + np.where(over, run, 0)
                block = block + extra
            block = block + ended
            k = np.where(ended, ss, k)
            live = block < last
            if not live.all():
                done[lane[~live]] = p[~live]
                lane, p, block, last, k, code = (x[live] for x in (lane, p, block, last, k, code))
        if spots:
            spot, place, s = map(np.concatenate, (spots, places, sizes))
            v = self._bits(place, s)
            self.coef.reshape(-1)[spot] = np.where(v < (1 << (s - 1)), v - (1 << s) + 1, v) << al
        return done

    def _ac_refine(self, p: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray, code: np.ndarray, ss: int, se: int, al: int) -> np.ndarray:
        width = se - ss + 1
        band = self.coef[order, ss : se + 1]
        zero = band == 0
        zeros = np.concatenate([np.zeros((len(order), 1), np.int64), np.cumsum(zero, 1)], 1)
        # Place of the i-th coefficient that was zero, and of the i-th that wasn't; width where there is none.
        place0 = np.sort(np.where(zero, np.arange(width), width), 1)
        place0 = np.concatenate([place0, np.full((len(order), 17), width)], 1)
        place1 = np.sort(np.where(zero, width, np.arange(width)), 1)
        done = p.copy()
        block, last, k = first.copy(), first + count, np.zeros(len(p), np.int64)
        lane, fresh, fixes = np.arange(len(p)), [], []
        eob = np.zeros(len(p), np.int64)
        while len(lane):
            idle = eob > 0  # blocks under an end-of-band run hold correction bits only
            found = self.look[code + self._peek(p)]
            sym = np.where(idle, 0, found & 255).astype(np.int64)
            p = p + np.where(idle, 0, found >> 8)
            run, s = sym >> 4, sym & 15
            over = idle | ((s == 0) & (run < 15))
            if (opens := over & ~idle).any():
                eob = np.where(opens, (1 << run) + self._bits(p, np.where(opens, run, 0)), eob)
                p = p + np.where(opens, run, 0)
            sign = p
            p = p + (s > 0)
            to = np.where(over, width, place0[block, np.minimum(zeros[block, k] + run, width + 16)])
            fix = (to - k) - (zeros[block, to] - zeros[block, k])
            fixes.append((block[fix > 0], (k - zeros[block, k])[fix > 0], fix[fix > 0], p[fix > 0]))
            new = (s > 0) & (to < width)
            fresh.append((order[block[new]] * 64 + ss + to[new], sign[new]))
            p = p + fix
            k = to + 1
            eob = eob - over
            ended = over | (k >= width)
            block = block + ended
            k = np.where(ended, 0, k)
            live = block < last
            if not live.all():
                done[lane[~live]] = p[~live]
                lane, p, block, last, k, code, eob = (x[live] for x in (lane, p, block, last, k, code, eob))
        flat = self.coef.reshape(-1)
        b, skip, n, at = (np.concatenate(x) for x in zip(*fixes, strict=True)) if fixes else (np.zeros(0, np.int64),) * 4
        row = np.repeat(np.arange(len(b)), n)
        i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        spot = order[b[row]] * 64 + ss + place1[b[row], skip[row] + i]
        flat[spot] += np.sign(flat[spot]) * (self._bits(at[row] + i, np.ones(len(row), np.int64)) << al)
        spot, sign = (np.concatenate(x) for x in zip(*fresh, strict=True)) if fresh else (np.zeros(0, np.int64),) * 2
        flat[spot] = np.where(self._bits(sign, np.ones(len(sign), np.int64)) == 1, 1, -1) << al
        return done

    # -- pixels

    def tensors(self) -> Iterator[np.ndarray]:
        """Each image's RGB tensor."""
        pixels: np.ndarray | None = None
        plain = all((q == 1).all() for m in self.images for q in m.quant.values())
        coef = self.coef
        if not plain:
            coef = coef.copy()
            for m in self.images:
                for first, _, _, q, wide, down in m.parts.values():
                    coef[first : first + wide * down] *= m.quant[q]
        # Integers below 2**53, so that the product is exact in any order of summation.
        pixels = np.clip((np.floor((coef.astype(np.float64) @ BASIS + 4096) / 8192) + 128), 0, 255).astype(np.int32)
        for m in self.images:
            planes = []
            for first, h, v, _, wide, down in m.parts.values():
                x = pixels[first : first + wide * down].reshape(down, wide, 8, 8).swapaxes(1, 2).reshape(8 * down, 8 * wide)
                if v != m.vmax:
                    x = np.repeat(x, m.vmax // v, 0)
                if h != m.hmax:
                    x = np.repeat(x, m.hmax // h, 1)
                planes.append(x[: m.height, : m.width])
            yield to_rgb(planes)


def to_rgb(planes: list[np.ndarray]) -> np.ndarray:
    """RGB of luma alone, or of Y, Cb, Cr, in 16-bit fixed point."""
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = planes[0] * 65536 + 32768, planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], 2) >> 16
    return np.clip(rgb, 0, 255).astype(np.uint8)


def decode_tensors(files: list[bytes]) -> list[np.ndarray]:
    """height x width x 3 arrays of progressive JPEG files (1 component, or 3 of any integer sampling)."""
    return list(_Batch(files).tensors())


def decode_payloads(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, tensor) of files that encode_payloads() wrote."""
    batch = _Batch(files)
    out = []
    for m, tensor in zip(batch.images, batch.tensors(), strict=True):
        (y, *_), (cb, *_), (cr, *_) = (m.parts[c] for c in (1, 2, 3))
        n = m.mcus_x * m.mcus_y
        c = batch.coef
        units = np.concatenate([c[y : y + 2 * n].reshape(n, 2, 64), c[cb : cb + n, None], c[cr : cr + n, None]], 1)[:, :, :USED]
        size = int(re.fullmatch(rb"payload=(\d+)", m.comment)[1])
        out.append((((units + CENTRE) & 255).astype(np.uint8).tobytes()[:size], tensor))
    return out


def feature(tensor: np.ndarray) -> str:
    """Size, channel sums and sums of squares of an RGB tensor."""
    x = tensor.reshape(-1, 3).astype(np.int64)
    sums, squares = x.sum(0), (x * x).sum(0)
    return f"{tensor.shape[1]}x{tensor.shape[0]};" + ";".join(f"{a}:{b}" for a, b in zip(sums.tolist(), squares.tolist(), strict=True))


# ---- Spark ---------------------------------------------------------------------------------


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def store_media(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, media: each text's UTF-8 payload in a progressive JPEG."""
    ship(rows.sparkSession)
    source = rows.select(rows[key].alias("k"), rows[text].cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for i, j in _groups([len(t) for t in texts]):
                files = encode_payloads([pad(t) for t in texts[i:j]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array(files, pa.binary())], names=["k", "n_bytes", "media"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, n_bytes long, media binary").withColumnRenamed("k", key)


def _decoded(files: list[bytes | None]) -> list[tuple[bytes, np.ndarray] | None]:
    """decode_payloads(), with None for files that are None or can't be decoded."""
    there = [f for f in files if f is not None]
    try:
        made = iter(decode_payloads(there) if there else [])
    except Exception:
        if len(files) == 1:
            return [None]
        return [x for f in files for x in _decoded([f])]
    return [None if f is None else next(made) for f in files]


def decode_media(rows: DataFrame, media: str = "media", tensors: bool = True) -> DataFrame:
    """All columns of ``rows`` but ``media``, and: height, width, tensor (binary, height x width x 3; only
    if asked), payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    All of these are null where the file is null or can't be decoded."""
    ship(rows.sparkSession)
    keep = [c for c in rows.columns if c != media]
    kinds = dict(rows.dtypes)
    made = [("height", pa.int32()), ("width", pa.int32()), *([("tensor", pa.binary())] if tensors else []), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    sql = {"int32": "int", "int64": "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(len(keep)).to_pylist()
            for i, j in _groups([len(f or b"") for f in files]):
                out: list[list] = [[] for _ in made]
                for f, found in zip(files[i:j], _decoded(files[i:j]), strict=True):
                    payload, tensor = found or (None, None)
                    values = [None] * len(made) if found is None else [*tensor.shape[:2], *([tensor.tobytes()] if tensors else []), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature(tensor)]
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(len(keep))), *(pa.array(v, t) for v, (_, t) in zip(out, made, strict=True))], names=[*keep, *(m[0] for m in made)])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{n} {sql.get(str(t), str(t))}" for n, t in made)])
    return rows.select(*keep, F.col(media)).mapInArrow(run, schema)
