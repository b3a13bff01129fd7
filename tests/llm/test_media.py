"""Frames that the module did not make: an encoder of baseline JPEG for tests, with the standard's tables."""

import struct

import numpy as np
import pytest

from vecloom.llm import avi_mjpeg as A


class Bits:
    def __init__(self):
        self.out = []

    def put(self, value, n):
        self.out += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def raw(self):
        bits = self.out + [1] * (-len(self.out) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")


def codes_of(counts, symbols):
    out, code, k = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def put_value(bits, v):
    n = abs(v).bit_length()
    bits.put(v if v >= 0 else v + (1 << n) - 1, n)


def put_block(bits, block, last, dc, ac):
    diff = int(block[0]) - last
    bits.put(*dc[abs(diff).bit_length()])
    put_value(bits, diff)
    run = 0
    top = max(np.flatnonzero(block), default=0)
    for k in range(1, 64):
        if k > top:
            bits.put(*ac[0])
            break
        if block[k] == 0:
            run += 1
            continue
        while run > 15:
            bits.put(*ac[0xF0])
            run -= 16
        bits.put(*ac[run << 4 | abs(int(block[k])).bit_length()])
        put_value(bits, int(block[k]))
        run = 0
    return int(block[0])


def jpeg(width, height, parts, quantiser, restart=0, tables=True):
    """parts: (h, v, blocks (rows, columns, 64))."""
    codes = {k: codes_of(*v) for k, v in A.STANDARD.items()}
    head = b"\xff\xd8" + A._segment(0xDB, bytes([0]) + bytes(quantiser.tolist()))
    head += A._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v, _) in enumerate(parts)))
    if tables:
        for k, (counts, symbols) in A.STANDARD.items():
            head += A._segment(0xC4, bytes([k, *counts, *symbols]))
    if restart:
        head += A._segment(0xDD, struct.pack(">H", restart))
    head += A._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0x11 if i else 0]) for i in range(len(parts))) + bytes([0, 63, 0]))
    single = len(parts) == 1
    down, across = (parts[0][2].shape[0] // (1 if single else parts[0][1]), parts[0][2].shape[1] // (1 if single else parts[0][0]))
    data, bits, last = b"", Bits(), [0] * len(parts)
    for u in range(down * across):
        if restart and u and u % restart == 0:
            data += bits.raw() + bytes([0xFF, 0xD0 + (u // restart - 1) % 8])
            bits, last = Bits(), [0] * len(parts)
        for p, (h, v, blocks) in enumerate(parts):
            h, v = (1, 1) if single else (h, v)
            for i in range(h * v):
                b = blocks[u // across * v + i // h, u % across * h + i % h]
                last[p] = put_block(bits, b, last[p], codes[1 if p else 0], codes[0x11 if p else 0x10])
    return head + data + bits.raw() + b"\xff\xd9"


def plain_samples(blocks, quantiser, width, height):
    rows, columns, _ = blocks.shape
    out = np.zeros((8 * rows, 8 * columns))
    for r in range(rows):
        for c in range(columns):
            freq = np.zeros((8, 8))
            for k, (u, v) in enumerate(A.ZIGZAG):
                freq[u, v] = blocks[r, c, k] * quantiser[k]
            for y in range(8):
                for x in range(8):
                    s = 0.0
                    for u in range(8):
                        for v in range(8):
                            if freq[u, v]:
                                s += (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * freq[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16)
                    out[8 * r + y, 8 * c + x] = s
    return np.clip(np.rint(out) + 128, 0, 255)[:height, :width]


def random_blocks(rng, rows, columns):
    x = rng.integers(-40, 40, (rows, columns, 64))
    x[..., 1:] *= rng.random((rows, columns, 63)) < 0.12
    return x


def test_zigzag():
    assert A.ZIGZAG[:10] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3), (1, 2), (2, 1), (3, 0)] and len(A.STANDARD[0x10][1]) == len(A.STANDARD[0x11][1]) == 162


@pytest.mark.parametrize("restart", [0, 2])
@pytest.mark.parametrize("tables", [True, False])
def test_foreign_frames(restart, tables):
    rng = np.random.default_rng(4)
    q = rng.integers(1, 6, 64)
    gray = random_blocks(rng, 3, 4)
    f = A.Frame(jpeg(27, 20, [(1, 1, gray)], q, restart, tables))
    assert (f.parts[0]["blocks"] == gray).all()
    assert np.abs(f.samples()[0].astype(int) - plain_samples(gray, q, 27, 20)).max() <= 1
    parts = [(2, 2, random_blocks(rng, 4, 6)), (1, 1, random_blocks(rng, 2, 3)), (1, 1, random_blocks(rng, 2, 3))]
    f = A.Frame(jpeg(45, 30, parts, q, restart, tables))
    assert all((p["blocks"] == b).all() for p, (_, _, b) in zip(f.parts, parts, strict=True))
    y, cb, cr = f.samples()
    assert y.shape == (30, 45) and cb.shape == cr.shape == (15, 23)
    assert np.abs(y.astype(int) - plain_samples(parts[0][2], q, 45, 30)).max() <= 1


def film(frames):
    chunks = b"".join(A._chunk(b"00dc", f) for f in frames)
    main = struct.pack("<14I", 100_000, 0, 0, 0x10, len(frames), 0, 1, 0, 16, 16, 0, 0, 0, 0)
    body = A._list(b"hdrl", A._chunk(b"avih", main)) + A._list(b"movi", chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def test_shots_of_a_foreign_film(spark):
    q = np.ones(64, np.int64)

    def frame(level):
        b = np.zeros((2, 2, 64), np.int64)
        b[..., 0] = (level - 128) * 8
        return jpeg(16, 16, [(1, 1, b)], q, tables=False)

    media = film([frame(40)] * 12 + [frame(200)] * 10)
    assert A.shots(media).tolist() == [12]
    rows = spark.createDataFrame([(1, bytearray(media)), (2, None)], "doc_id long, media binary")
    got = A.clips(A.films(rows)).orderBy("clip").collect()
    assert [(r.doc_id, r.clip, round(r.start_s, 3), round(r.end_s, 3)) for r in got] == [(1, 0, 0.0, 1.2), (1, 1, 1.2, 2.2)]


def test_broken_frames():
    good = jpeg(16, 16, [(1, 1, random_blocks(np.random.default_rng(1), 2, 2))], np.ones(64, np.int64))
    for bad in (good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, IndexError, struct.error)):
            A.Frame(bad)
    with pytest.raises(ValueError):
        A.units([good])
