"""Token ids as binary shards.

A shard is one binary image: a header, an Elias-Fano code of the documents' ends, one of their ids, and the concatenated token
ids in 2 bytes each (4 where the vocabulary needs them). Elias-Fano keeps the low bits of each value as they are and the high bits in
unary; every SAMPLE-th one's place is kept, so that select finds an offset without a table of 64-bit numbers.

Documents are dealt out by ranges of doc_id and sorted, so the images, in order of (part, seq), hold them in ascending order. Images are
written by Spark as rows of a Parquet table in the shared folder, about SHARD_IDS ids each, and read back from there.

Texts are cut where a blank and a word begin and at line ends - always an end of a pre-token of byte-level BPE. Each distinct cut of SLICE
text bytes is looked up once, among CACHE encodings that are kept; the tokenizers library encodes what is not there. A null text is an
empty text: just the end id. Null ids come first and stay null. Repeated rows are encoded each. An empty table has no shards. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import slices, spread, stash, text_bytes

MAGIC, SAMPLE = b"VLTS\x01\x00\x00\x00", 64
SHARD_IDS, CACHE, SLICE = 1 << 20, 500_000, 1 << 22
END_ID = 0
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_GRAPH = np.zeros(256, bool)
_GRAPH[33:127] = True
#: Bytes that begin a character which is no white space: white space beyond ASCII begins with C2, E1, E2 or E3.
_SOLID = _GRAPH.copy()
_SOLID[0xC3:] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False


class EliasFano:
    """A sequence of non-decreasing numbers under a bound."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        n = len(values)
        k = max(0, (max(1, bound) // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        bits = ((v[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(k)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, k, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QIIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, k, low, high, s = struct.unpack_from("<QIIII", raw, at)
        at += 24
        a, b, c = at + low, at + low + high, at + low + high + 4 * s
        return cls(n, k, bytes(raw[at:a]), bytes(raw[a:b]), np.frombuffer(raw[b:c], "<u4")), c

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, ones are counted in at most a few words."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        pos = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        while left:
            byte = self.high[(pos + 1) // 8] >> ((pos + 1) % 8)
            span = 8 - (pos + 1) % 8
            ones = byte.bit_count()
            if ones < left:
                left -= ones
                pos += span
                continue
            while left:
                pos += 1
                left -= self.high[pos // 8] >> (pos % 8) & 1
        low = int.from_bytes(self.low[i * self.low_bits // 8 : ((i + 1) * self.low_bits + 7) // 8], "little") >> (i * self.low_bits % 8)
        return (pos - i) << self.low_bits | low & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out += bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out


def image(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """The shard of documents in ascending order of id, nulls first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    rel = (known - first).astype(np.uint64)
    count = len(ids) // width
    head = MAGIC + struct.pack("<IQqQ", width, len(doc_ids) - len(known), first, count)
    return head + EliasFano.of(ends, count + 1).to_bytes() + EliasFano.of(rel, int(rel[-1]) + 1 if len(rel) else 1).to_bytes() + ids


class Shard:
    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a shard")
        self.width, nulls, first, self.count = struct.unpack_from("<IQqQ", raw, 8)
        view = memoryview(raw)
        self.ends, at = EliasFano.read(view, 36)
        known, at = EliasFano.read(view, at)
        self.doc_ids = [None] * nulls + (known.all() + first).tolist()
        self.ids = np.frombuffer(view[at:], f"<u{self.width}", self.count)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def pre_tokens(piece: str) -> list[str]:
    """The pre-tokens of a piece. Most are a word, or a word and a mark; only the others need the pattern."""
    word = piece[1:] if piece.startswith(" ") else piece
    if word.isalpha():
        return [piece]
    if word[-1:] in (".", ",") and word[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return _PRE.findall(piece)


def cuts(raw: np.ndarray) -> np.ndarray:
    """Whether each byte begins a piece: a blank before what is surely no white space, a line end after a mark or letter of ASCII, and what
    is surely no white space after a line end. Byte-level BPE ends a pre-token at each of them."""
    out = np.zeros(len(raw), bool)
    solid, line = _SOLID[raw], raw == 10
    out[:-1] |= (raw[:-1] == 32) & solid[1:]
    out[1:] |= line[1:] & _GRAPH[raw[:-1]] | line[:-1] & solid[1:]
    return out


class Encoder:
    """Ids of texts, with a bounded memory of pieces."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # of what is between the added tokens; these are split off before
        tokens = self.tok.get_added_tokens_decoder() if added else {}
        for t in tokens.values():
            if t.lstrip or t.rstrip or t.single_word or (t.normalized and self.tok.normalizer):
                raise ValueError(f"added token {t.content!r} is not matched as it is written")
        self.added = {t.content: i for i, t in tokens.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.pieces: dict[bytes, bytes] = {}

    def _learn(self, used: list[bytes], missing: list[bytes]) -> None:
        if len(self.pieces) > CACHE:  # what this call needs of the old pieces stays
            own = {p: self.pieces[p] for p in set(used).difference(missing)}
            self.pieces.clear()
            self.pieces.update(own)
        split = [pre_tokens(p.decode()) for p in missing]
        new = list({x for parts in split for x in parts})
        # one call for all: each stays a pre-token of its own
        e = self.tok.encode(new, is_pretokenized=True, add_special_tokens=False)
        at = (np.searchsorted(np.array(e.word_ids), np.arange(len(new) + 1)) * self.width).tolist()
        raw = np.array(e.ids, self.kind).tobytes()
        ids = dict(zip(new, map(raw.__getitem__, map(slice, at, at[1:])), strict=False))
        for p, parts in zip(missing, split, strict=True):
            self.pieces[p] = ids[parts[0]] if len(parts) == 1 else b"".join(map(ids.__getitem__, parts))

    def encode_all(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, their number by text)"""
        text = text.fill_null("")
        if not any(pc.any(pc.match_substring(text, t)).as_py() for t in self.added):
            return self._plain(text)
        parts = [self.at_added.split(t) for t in text.to_pylist()]  # every second is an added token
        flat, n = self._plain(pa.array([x for p in parts for x in p[::2]], pa.string()))
        between = iter(np.split(flat, np.cumsum(n)[:-1]))
        own = [[np.array([self.added[x]], flat.dtype) if j % 2 else next(between) for j, x in enumerate(p)] for p in parts]
        return np.concatenate([x for p in own for x in p]), np.array([sum(map(len, p)) for p in own])

    def _plain(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, at = text_bytes(text)
        counts = np.zeros(len(text), np.int64)
        if not len(raw):
            return np.zeros(0, self.kind), counts
        some = np.diff(at) > 0
        begin = cuts(raw)
        begin[at[:-1][some]] = True
        start = np.flatnonzero(begin)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(raw)).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        used = pieces.dictionary.to_pylist()
        missing = [p for p in used if p not in self.pieces]
        if missing:
            self._learn(used, missing)
        ids = list(map(self.pieces.__getitem__, used))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        which = pieces.indices.to_numpy()
        n = size[which]
        counts[some] = np.add.reduceat(n, np.searchsorted(start, at[:-1][some]))
        return np.frombuffer(b"".join(ids), self.kind)[spread((np.cumsum(size) - size)[which], n)], counts


IMAGES = "part int, seq int, docs long, ids long, image binary"


def encoded(docs: DataFrame, tokenizer: str, added: bool = False) -> DataFrame:
    """Shard images (part, seq, docs, ids, image) of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, added)
        seq, part, ids, flats, sizes = 0, None, [], [], []

        def flush() -> pa.RecordBatch:
            flat, ends = np.concatenate(flats), np.cumsum(np.concatenate(sizes))
            blob = image([x for d in ids for x in d.to_pylist()], ends, flat.tobytes(), enc.width)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": [len(ends)], "ids": [len(flat)], "image": [blob]})

        for batch in batches:
            for a, b in slices(batch.column(2), SLICE):
                part = batch.column(0)[0].as_py()
                got, n = enc.encode_all(batch.column(2).slice(a, b - a))
                flat = np.full(len(got) + len(n), END_ID, enc.kind)
                own = np.ones(len(flat), bool)
                own[np.cumsum(n + 1) - 1] = False
                flat[own] = got
                ids.append(batch.column(1).slice(a, b - a))
                flats.append(flat)
                sizes.append(n + 1)
                if sum(map(len, flats)) >= SHARD_IDS:
                    yield flush()
                    seq += 1
                    ids, flats, sizes = [], [], []
        if ids:
            yield flush()

    return rows.mapInArrow(scan, IMAGES)


_made: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, added: bool) -> Encoder:
    """One for a worker: its memory lasts over tasks."""
    if (path, added) not in _made:
        _made[path, added] = Encoder(path, added)
    return _made[path, added]


def offsets(images: DataFrame) -> DataFrame:
    """(part, seq, base): ids before each image. Sums run within parts, then over parts."""
    meta = images.select("part", "seq", "ids")
    of_parts = meta.groupBy("part").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return meta.withColumn("own", F.coalesce(F.sum("ids").over(inner), F.lit(0))).join(starts, "part").select("part", "seq", (F.col("start") + F.col("own")).alias("base"))


def read_documents(images: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in stored images."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = Shard(raw)
                ends = np.array([s.ends.select(i) for i in range(s.ends.n)], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "own", "n_tokens", "ids_crc32"],
                )

    docs = images.select("part", "seq", "image").mapInArrow(scan, "part int, seq int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return docs.join(offsets(images), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, tokenizer: str, added: bool = False) -> DataFrame:
    """Encode, store, read back: (doc_id, start, n_tokens, ids_crc32)."""
    return read_documents(stash(encoded(docs, tokenizer, added), "token-shards"))
