"""Media columns: AVI with motion JPEG.

A payload is padded with bytes 255 to frames of 576 bytes, 24 x 24 units: 9 blocks of 64. The unit of JPEG is the quantised
coefficient, whose coding loses nothing, so byte b is stored as a coefficient 256 + b; of a block's DC, whose differences are
stored, as a difference of 256 + b with alternating sign. All have the one size category 9, so the frame's own Huffman tables hold a
single code and each unit takes 10 bits: frames are ordinary baseline JPEG, and whole batches of them are packed and unpacked by
array operations. Any other baseline frame, of any size, sampling and tables, is decoded symbol by symbol, dequantised and transformed to
samples (Frame); those that bring no Huffman tables have the standard's.

Shots are found where the difference of the histograms of adjacent frames is over the mean of the WINDOW differences before by
SIGMAS deviations and LEAST: histograms of the stored units for payloads, of the decoded brightness for other films (films). A
text's feature names its frames, shots and cuts; its clips are the shots' times.

A null text is an empty one: one frame of padding. Equal texts have equal values; repeated rows and null ids are kept. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import slices

FRAME, BLOCKS, SIDE, FPS = 576, 9, 24, 25
WINDOW, SIGMAS, LEAST, HIST_BINS = 8, 3.0, 0.05, 16
CATEGORY = 9


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int) -> bytes:
    """A table with one code of one bit."""
    return bytes([kind << 4, 1, *[0] * 15, CATEGORY])


HEAD = (
    b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, _huffman(0) + _huffman(1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
TAIL = b"\xff\xd9"


def pack(frames: np.ndarray) -> bytes:
    """(n, 576) bytes as n x 720 bytes of entropy-coded units, not yet stuffed."""
    v = frames.reshape(-1, BLOCKS, 64).astype(np.uint16)
    odd = v[:, 1::2, 0].copy()
    v += 256
    v[:, 1::2, 0] = 255 - odd
    w = v.reshape(-1, 4)
    out = np.empty((len(w), 5), np.uint8)
    out[:, 0] = w[:, 0] >> 2
    out[:, 1] = (w[:, 0] << 6) | (w[:, 1] >> 4)
    out[:, 2] = (w[:, 1] << 4) | (w[:, 2] >> 6)
    out[:, 3] = (w[:, 2] << 2) | (w[:, 3] >> 8)
    out[:, 4] = w[:, 3]
    return out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    """Inverse of pack."""
    x = np.frombuffer(raw, np.uint8).reshape(-1, 5).astype(np.uint16)
    w = np.empty((len(x), 4), np.uint16)
    w[:, 0] = (x[:, 0] << 2) | (x[:, 1] >> 6)
    w[:, 1] = ((x[:, 1] & 63) << 4) | (x[:, 2] >> 4)
    w[:, 2] = ((x[:, 2] & 15) << 6) | (x[:, 3] >> 2)
    w[:, 3] = ((x[:, 3] & 3) << 8) | x[:, 4]
    v = w.reshape(-1, BLOCKS, 64)
    out = (v & 255).astype(np.uint8)
    out[:, 1::2, 0] = 255 - out[:, 1::2, 0]
    return out.reshape(-1, FRAME)


PACKED = FRAME * 10 // 8


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode(payload: bytes) -> bytes:
    """The AVI file of a payload of whole frames."""
    packed = pack(np.frombuffer(payload, np.uint8).reshape(-1, FRAME))
    chunks, index, at = [], [], 4
    for i in range(0, len(packed), PACKED):
        c = _chunk(b"00dc", HEAD + packed[i : i + PACKED].replace(b"\xff", b"\xff\0") + TAIL)
        size = struct.unpack_from("<I", c, 4)[0]
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, size))
        chunks.append(c)
        at += len(c)
    n = len(chunks)
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    body = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    body += _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def frames_of(media: bytes) -> list[bytes]:
    """The JPEG frames, by the index; by walking the movie list if there is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif name == b"idx1":
            index = (at + 8, size)
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movie list")
    out = []
    if index:
        entries = np.frombuffer(media, "<u4", index[1] // 4, index[0]).reshape(-1, 4)
        base = movi[0] if not len(entries) or media[movi[0] + int(entries[0, 2]) :][:4] == media[index[0] : index[0] + 4] else 0
        for name, _, offset, size in entries.tolist():
            if struct.pack("<I", name)[2:] in (b"dc", b"db"):
                out.append(media[base + offset + 8 : base + offset + 8 + size])
        return out
    at = movi[0] + 4
    while at + 8 <= movi[1]:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name[2:] in (b"dc", b"db"):
            out.append(media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return out


# Fixed values of the JPEG standard: the tables of frames that bring none (numbers of codes by length, then the symbols), and the order
# in which a block's coefficients are stored.
_REST = [16 * a + b for a in range(16) for b in range(1, 11)]
STANDARD = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12))),
    0x10: (
        [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
        [
            0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08,
            0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A,
        ],
    ),
    0x11: (
        [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
        [
            0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91,
            0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1,
        ],
    ),
}
for _table in (0x10, 0x11):  # the other symbols follow in ascending order
    _head = STANDARD[_table][1]
    STANDARD[_table] = (STANDARD[_table][0], _head + [x for x in _REST if x not in _head])
#: Row and column of each stored coefficient: along the diagonals, in turn down and up.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
_AT = np.array([8 * r + c for r, c in ZIGZAG])
#: Basis of the cosine transform: samples by frequency.
_COSINES = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) / 2 * np.where(np.arange(8) == 0, np.sqrt(0.5), 1.0)


def _codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int]]:
    """(symbol, bits) by the next 16 bits; bits 0 where no code begins so."""
    out, code, k = [(0, 0)] * 65536, 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            first = code << (16 - bits)
            out[first : first + (1 << (16 - bits))] = [(symbols[k], bits)] * (1 << (16 - bits))
            code, k = code + 1, k + 1
        code <<= 1
    return out


_tables: dict[tuple, list] = {}


def _table_of(counts: list[int], symbols: list[int]) -> list[tuple[int, int]]:
    """Frames of one film share their tables; few are kept."""
    key = (tuple(counts), tuple(symbols))
    if key not in _tables:
        if len(_tables) >= 16:
            _tables.clear()
        _tables[key] = _codes(counts, symbols)
    return _tables[key]


class Frame:
    """A baseline JPEG frame: its components, each with sampling factors (h, v), quantiser and coefficients (rows, columns, 64) in stored order."""

    def __init__(self, jpeg: bytes):
        self.parts: list[dict] = []
        quantisers: dict[int, np.ndarray] = {}
        tables = {k: _table_of(*v) for k, v in STANDARD.items()}
        at, restart = 2, 0
        while True:
            while jpeg[at] == 0xFF and jpeg[at + 1] == 0xFF:
                at += 1
            if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
                raise ValueError("not a JPEG frame")
            marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
            body = jpeg[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                    body = body[1 + 64 * (wide + 1) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = _table_of(list(body[1:17]), list(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC0:
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not self.height or not self.width:
                    raise ValueError("frames have 8 bits a sample and a size")
                self.parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                break
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("baseline frames only")
        if not self.parts or body[0] != len(self.parts):
            raise ValueError("one scan of all components is supported")
        for p in self.parts:
            p["dc"], p["ac"] = next((tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0]) if body[1 + 2 * i] == p["id"])
            p["quantiser"] = quantisers[p["q"]]
        self._scan(jpeg[at:], restart)

    def _scan(self, data: bytes, restart: int) -> None:
        most_h, most_v = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        if len(self.parts) == 1:  # blocks in rows, whatever the factors
            self.parts[0] |= {"h": 1, "v": 1}
            most_h = most_v = 1
        across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        for p in self.parts:
            p["blocks"] = np.zeros((down * p["v"], across * p["h"], 64), np.int32)
        runs, pieces, at = [], [], 0
        while True:  # the coded bytes up to each restart mark or the end
            mark = data.find(b"\xff", at)
            if mark < 0 or mark + 1 >= len(data):
                pieces.append(data[at:])
                break
            nxt = data[mark + 1]
            pieces.append(data[at : mark + 1] if nxt == 0 else data[at:mark])
            at = mark + 2
            if nxt and nxt != 0xFF:
                runs.append(b"".join(pieces))
                pieces = []
                if not 0xD0 <= nxt <= 0xD7:
                    break
            elif nxt == 0xFF:
                at -= 1
        if pieces:
            runs.append(b"".join(pieces))
        units = across * down
        each = restart or units
        for r in range(-(-units // each)):
            if r >= len(runs):
                raise ValueError("the frame ends early")
            self._run(runs[r], range(r * each, min(units, (r + 1) * each)), across)

    def _run(self, raw: bytes, units: range, across: int) -> None:
        raw, pos, end = raw + b"\xff" * 8, 0, 8 * len(raw)
        last = [0] * len(self.parts)

        def peek() -> int:
            return int.from_bytes(raw[pos >> 3 : (pos >> 3) + 3], "big") >> (8 - (pos & 7)) & 0xFFFF

        def value(n: int) -> int:
            nonlocal pos
            v = int.from_bytes(raw[pos >> 3 : (pos >> 3) + 3], "big") >> (24 - (pos & 7) - n) & ((1 << n) - 1)
            pos += n
            return v if v >> (n - 1) else v - (1 << n) + 1

        for u in units:
            for k, p in enumerate(self.parts):
                dc, ac = p["dc"], p["ac"]
                for i in range(p["h"] * p["v"]):
                    out = p["blocks"][u // across * p["v"] + i // p["h"], u % across * p["h"] + i % p["h"]]
                    s, bits = dc[peek()]
                    pos += bits
                    if s:
                        last[k] += value(s)
                    out[0] = last[k]
                    c = 1
                    while c < 64:
                        s, bits = ac[peek()]
                        pos += bits
                        if not bits:
                            raise ValueError("no such code")
                        if s == 0:
                            break
                        c += s >> 4
                        if s & 15:
                            if c > 63:
                                raise ValueError("a block of more than 64 coefficients")
                            out[c] = value(s & 15)
                        c += 1
                    if pos > end:
                        raise ValueError("the frame ends early")

    def samples(self) -> list[np.ndarray]:
        """Each component's samples (rows, columns), 0 to 255: dequantised, transformed, shifted by 128 and clipped."""
        out = []
        most_h, most_v = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        for p in self.parts:
            freq = np.zeros(p["blocks"].shape)
            freq[..., _AT] = p["blocks"] * p["quantiser"]
            x = _COSINES @ freq.reshape(*freq.shape[:2], 8, 8) @ _COSINES.T
            x = np.clip(np.rint(x) + 128, 0, 255).astype(np.uint8)
            rows, columns = x.shape[:2]
            full = x.transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
            out.append(full[: -(-self.height * p["v"] // most_v), : -(-self.width * p["h"] // most_h)])
        return out


def coefficients(jpeg: bytes) -> np.ndarray:
    """(blocks, 64) quantised coefficients, in stored order, of a frame's first component (brightness)."""
    return Frame(jpeg).parts[0]["blocks"].reshape(-1, 64)


def histogram(samples: np.ndarray) -> np.ndarray:
    """HIST_BINS counts, as shares of all."""
    return np.bincount(samples.ravel() >> 4, minlength=HIST_BINS) / max(1, samples.size)


def shots(media: bytes) -> np.ndarray:
    """The frames, from 1, that begin a new shot of any AVI file of motion JPEG, by the brightness of its decoded frames."""
    return changes(np.array([histogram(Frame(f).samples()[0]) for f in frames_of(media)]).reshape(-1, HIST_BINS))


def units(frames: list[bytes]) -> np.ndarray:
    """(frames, 576) stored bytes."""
    h, t = len(HEAD), len(TAIL)
    if all(f.startswith(HEAD) and f.endswith(TAIL) for f in frames):
        raw = b"".join(f[h:-t].replace(b"\xff\0", b"\xff") for f in frames)
        if len(raw) == PACKED * len(frames):
            return unpack(raw)
    out = []
    for f in frames:
        c = coefficients(f).copy()
        if c.shape != (BLOCKS, 64):
            raise ValueError(f"a payload's frames are {SIDE} x {SIDE}")
        c[1:, 0] = np.diff(c[:, 0])
        out.append((np.abs(c) - 256).astype(np.uint8).reshape(FRAME))
    return np.array(out, np.uint8).reshape(-1, FRAME)


def cuts(frames: np.ndarray) -> np.ndarray:
    """Frames, from 1, that begin a new shot of stored units (frames, 576)."""
    n = len(frames)
    flat = (frames >> 4).astype(np.int64) + np.arange(n)[:, None] * HIST_BINS
    return changes(np.bincount(flat.ravel(), minlength=n * HIST_BINS).reshape(n, HIST_BINS) / max(1, frames.shape[1]))


def changes(hist: np.ndarray) -> np.ndarray:
    """Frames, from 1, whose histogram differs from the one before by more than the mean of the WINDOW differences before by SIGMAS
    deviations and LEAST."""
    if len(hist) < 2:
        return np.zeros(0, np.int64)
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    one, two = (np.concatenate([[0], np.cumsum(x)]) for x in (d, d * d))
    i = np.arange(len(d))
    lo = np.maximum(0, i - WINDOW)
    k = np.maximum(i - lo, 1)
    mean = (one[i] - one[lo]) / k
    dev = np.sqrt(np.maximum((two[i] - two[lo]) / k - mean**2, 0))
    return np.flatnonzero((i > 0) & (d > mean + SIGMAS * dev + LEAST)) + 1


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME or FRAME * (not text))


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media)"""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                raw = [(t or "").encode() for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode(payload(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, cuts array<int>, frames int"


def read_back(media: DataFrame) -> DataFrame:
    """What the stored form holds: digests of the payload, and shots."""

    def one(m: bytes) -> tuple:
        x = units(frames_of(m))
        raw, c = x.tobytes(), cuts(x)
        feature = f"frames={len(x)};shots={len(c) + 1};cuts={','.join(map(str, c))}"
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, c.tolist(), len(x)

    names = [f.split()[0] for f in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(m.as_py()) for m in batch.column(2)]
            cols = list(zip(*got, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(scan, READ)


def films(media: DataFrame) -> DataFrame:
    """(doc_id, cuts, frames, fps) of any AVI files of motion JPEG (doc_id, media): decoded frame by frame; null for a null file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # a file at a time
                m = batch.column(1)[i].as_py()
                found = (None, None, None) if m is None else (shots(m).tolist(), len(frames_of(m)), frame_rate(m))
                kinds = (pa.list_(pa.int32()), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x], k) for x, k in zip(found, kinds, strict=True))], ["doc_id", "cuts", "frames", "fps"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(scan, "doc_id long, cuts array<int>, frames int, fps double")


def frame_rate(media: bytes) -> float:
    """Frames a second, by the main header."""
    at = media.find(b"avih")
    step = struct.unpack_from("<I", media, at + 8)[0] if at >= 0 else 0
    return 1e6 / step if step else float(FPS)


def timed(fps=FPS) -> Column:
    """Of a row with cuts and frames: the clips, an array of (start_s, end_s)."""
    starts, ends = F.concat(F.array(F.lit(0)), "cuts"), F.concat("cuts", F.array("frames"))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda t: F.struct((t["s"] / fps).alias("start_s"), (t["e"] / fps).alias("end_s")))


def clips(read: DataFrame) -> DataFrame:
    """(doc_id, clip, start_s, end_s): a row a shot of rows with cuts and frames (and fps, else FPS)."""
    rows = read.where("frames > 0").select("doc_id", F.posexplode(timed(F.col("fps") if "fps" in read.columns else FPS)).alias("clip", "t"))
    return rows.select("doc_id", "clip", "t.start_s", "t.end_s")
