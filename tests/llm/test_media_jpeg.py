"""The codec against a decoder that follows the standard bit by bit, and exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import media_jpeg as m

SAMPLES = [b"", b"a", b"hello world " * 40, bytes(range(256)) * 3, bytes([100, 101, 102]) * 400, b"e" * 700, bytes([255, 0, 128]) * 200]


class Serial:
    """Coefficients of a progressive file, one bit at a time."""

    def __init__(self, data):
        self.data, self.tables, self.interval = data, {}, 0
        at = 2
        while data[at + 1] != 0xD9:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC4:
                code, k, table = 0, 17, {}
                for n in range(1, 17):
                    for _ in range(body[n]):
                        table[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                self.tables[body[0]] = table
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif marker == 0xC2:
                self.h, self.w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])]
                self.grid = {c: np.zeros((self.h // 8 * v, self.w // 16 * x, 64), int) for c, x, v in self.parts}
            elif marker == 0xDA:
                at = self.scan(body, at)

    def scan(self, body, at):
        names = [body[1 + 2 * i] for i in range(body[0])]
        ids = [body[2 + 2 * i] for i in range(body[0])]
        ss, se, ah, al = *body[-3:-1], body[-1] >> 4, body[-1] & 15
        if len(names) == 1:
            g = self.grid[names[0]]
            mcus = [[(0, g[y, x])] for y in range(g.shape[0]) for x in range(g.shape[1])]
        else:
            mcus = []
            for y in range(self.h // 8):
                for x in range(self.w // 16):
                    mcus.append([(i, self.grid[c][y * v + b, x * h + a]) for i, (c, h, v) in enumerate(self.parts) for b in range(v) for a in range(h)])
        for first in range(0, len(mcus), self.interval or len(mcus)):
            raw, end = b"", at
            while not (self.data[end] == 255 and self.data[end + 1] != 0):
                raw += self.data[end : end + 1]
                end += 2 if self.data[end] == 255 else 1
            at = end + 2 if 0xD0 <= self.data[end + 1] <= 0xD7 else end
            self.bits, self.p = "".join(f"{b:08b}" for b in raw), 0
            held, self.run = [0] * 4, 0
            for mcu in mcus[first : first + (self.interval or len(mcus))]:
                for i, block in mcu:
                    if ss == 0 and ah == 0:
                        s = self.symbol(ids[i] >> 4)
                        held[i] += self.value(s)
                        block[0] = held[i] << al
                    elif ss == 0:
                        block[0] |= self.get(1) << al
                    elif ah == 0:
                        self.first(block, ids[0], ss, se, al)
                    else:
                        self.refine(block, ids[0], ss, se, al)
        return at

    def get(self, n):
        v = int(self.bits[self.p : self.p + n] or "0", 2)
        assert self.p + n <= len(self.bits)
        self.p += n
        return v

    def value(self, s):
        v = self.get(s) if s else 0
        return v if not s or v >> (s - 1) else v - (1 << s) + 1

    def symbol(self, table):
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.get(1)
            if (n, code) in self.tables[table]:
                return self.tables[table][n, code]
        raise AssertionError("no code")

    def first(self, block, table, ss, se, al):
        if self.run:
            self.run -= 1
            return
        k = ss
        while k <= se:
            r, s = divmod(self.symbol(0x10 | table & 15), 16)
            if s:
                k += r
                block[k] = self.value(s) << al
                k += 1
            elif r == 15:
                k += 16
            else:
                self.run = (1 << r) + (self.get(r) if r else 0) - 1
                return

    def refine(self, block, table, ss, se, al):
        k = ss
        def fix(k):
            if self.get(1):
                block[k] += (1 if block[k] > 0 else -1) << al
        while k <= se and not self.run:
            r, s = divmod(self.symbol(0x10 | table & 15), 16)
            new = 0
            if s:
                new = (1 if self.get(1) else -1) << al
            elif r < 15:
                self.run = (1 << r) + (self.get(r) if r else 0)
                break
            while k <= se:
                if block[k]:
                    fix(k)
                elif r:
                    r -= 1
                else:
                    if new:
                        block[k] = new
                    k += 1
                    break
                k += 1
        if self.run:
            while k <= se:
                if block[k]:
                    fix(k)
                k += 1
            self.run -= 1


def serial_rgb(data):
    s = Serial(data)
    planes = []
    for c, h, _ in s.parts:
        g = s.grid[c]
        out = np.zeros((8 * g.shape[0], 8 * g.shape[1]))
        u = np.arange(8)
        basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) / 2 * np.where(u == 0, np.sqrt(0.5), 1)
        for y in range(g.shape[0]):
            for x in range(g.shape[1]):
                f = np.zeros(64)
                f[m.ZIGZAG] = g[y, x]
                out[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis @ f.reshape(8, 8) @ basis.T
        planes.append(np.clip(np.repeat(out, 2 // h, 1) + 128, 0, 255))
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return s, np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)


def test_files_follow_the_standard():
    payloads = [m.pad(p) for p in SAMPLES]
    files = m.encode_payloads(payloads)
    batch = m._Batch(files)
    for f, image, (payload, tensor), want in zip(files, batch.images, m.decode_payloads(files), payloads, strict=True):
        assert payload == want
        s, rgb = serial_rgb(f)
        for c, _, _ in s.parts:
            first, *_, wide, down = image.parts[c]
            assert (batch.coef[first : first + wide * down].reshape(down, wide, 64) == s.grid[c]).all()
        assert tensor.shape == rgb.shape and abs(tensor.astype(float) - rgb).max() <= 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=600), st.text(max_size=200).map(str.encode)), min_size=1, max_size=5))
def test_round_trip(payloads):
    padded = [m.pad(p) for p in payloads]
    assert [p for p, _ in m.decode_payloads(m.encode_payloads(padded))] == padded
    assert all(len(p) % m.UNIT == 0 and len(p) > 0 for p in padded)


def test_a_file_does_not_depend_on_its_batch():
    files = m.encode_payloads([m.pad(p) for p in SAMPLES])
    assert files == [m.encode_payloads([m.pad(p)])[0] for p in SAMPLES]
    together, alone = m.decode_tensors(files), [m.decode_tensors([f])[0] for f in files]
    assert all((a == b).all() for a, b in zip(together, alone, strict=True))


def test_tall_payloads_take_several_columns(monkeypatch):
    monkeypatch.setattr(m, "TALLEST", 5)
    payload = m.pad(bytes(range(256)) * 10)
    ((back, tensor),) = m.decode_payloads(m.encode_payloads([payload]))
    assert back == payload and tensor.shape == (40, 48, 3)


def test_damaged_files_fail():
    (f,) = m.encode_payloads([m.pad(b"some text")])
    with pytest.raises((ValueError, IndexError)):
        m.decode_tensors([f[:40]])
    with pytest.raises(ValueError):
        m.decode_tensors([b"no jpeg" * 10])


def test_media_column(spark):
    rows = [(1, "same"), (2, "same"), (3, None), (4, ""), (None, "é" * 300), (1, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS media", "1 AS width")
    got = m.decode_media(m.store_media(df)).collect()
    assert len(got) == len(rows) and len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}) == 1
    for r in got:
        text = next(t for k, t in rows if k == r.doc_id) or ""
        payload = m.pad(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r.tensor) == r.height * r.width * 3
    assert m.decode_media(m.store_media(df.limit(0))).collect() == []


def test_null_and_broken_files_have_no_values(spark):
    from millrace.llm.media_jpeg import decode_media, store_media

    whole = store_media(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")).collect()
    rows = [(r.doc_id, bytes(r.media)) for r in whole] + [(3, None), (4, b""), (5, b"no picture"), (6, bytes(whole[0].media)[:200])]
    got = {r.doc_id: r for r in decode_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == 192 and len(got) == 6
    assert all(got[k].feature is None and got[k].payload_sha256 is None for k in (3, 4, 5))
