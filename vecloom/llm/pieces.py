"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The pieces of a given model are the automaton's words. One pass over a text meets, at each position, every piece that ends there
(by the output links, longest first), and each relaxes the best score of the position: the Viterbi segmentation of greatest total score. A
character that no piece covers alone costs the least score less UNKNOWN, and is written as byte pieces if the model has them. Among
equal scores the longest last piece wins, and a piece wins over an unknown character.

Blanks are written as U+2581 and one is put before the text, as the model's normaliser does (identity, dummy prefix). If no piece has
anything before an U+2581 but U+2581, no piece goes from a word into the next, so the best path is the words' best paths in a row. Each
distinct word of SLICE text bytes is segmented once: words of up to LONGEST bytes step through the automaton together, one byte of
all of them at a time; longer ones, and whole texts under other models, by themselves.

A null or empty text has no pieces and decodes to the empty text. U+2581 in a text decodes as a blank. Repeated rows are alike; null ids
are kept. An empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import slices, spread, text_bytes, trim

SPACE, UNKNOWN, BLANK = "▁", 10.0, 32
SLICE, LONGEST, TOGETHER = 1 << 22, 256, 1 << 13


class Automaton:
    """Over the bytes of words, whose blanks are BLANK: every step is one look-up, as the failure links are worked into the table."""

    def __init__(self, words: list[bytes], scores: list[float], ids: list[int]):
        used = sorted({b for w in words for b in w})
        self.kind = np.zeros(256, np.int32)  # bytes that no word has are of kind 0
        self.kind[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        depth, piece, score = [0], [-1], [0.0]
        for w, s, i in zip(words, scores, ids, strict=True):
            at = 0
            for b in w:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    piece.append(-1)
                    score.append(0.0)
                at = nxt
            piece[at], score[at] = i, s
        n = len(children)
        self.width = len(used) + 1
        step = np.zeros((n, self.width), np.int32)
        link = np.zeros(n, np.int32)  # the longest proper suffix that is a piece; 0 for none
        fail = [0] * n
        queue = [0]
        for s in queue:  # by depth
            if s:
                step[s] = step[fail[s]]
                link[s] = fail[s] if piece[fail[s]] >= 0 else link[fail[s]]
            for b, c in children[s].items():
                k = int(self.kind[b])
                fail[c] = int(step[s, k]) if s else 0
                step[s, k] = c
                queue.append(c)
        self.step, self.link = step.ravel(), link
        self.depth, self.piece, self.score = np.array(depth, np.int32), np.array(piece, np.int32), np.array(score)
        self.first = np.where(self.piece >= 0, np.arange(n, dtype=np.int32), link)  # the longest piece that ends here


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        plain = [i for i in plain if self.pieces[i] and " " not in self.pieces[i]]  # a text's blanks are never left as they are
        self.scores = {i: sp.get_score(i) for i in plain}
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN
        self.single = {self.pieces[i] for i in plain if len(self.pieces[i]) == 1}
        self.by_words = all(SPACE not in self.pieces[i].lstrip(SPACE) for i in plain)
        self.auto = Automaton([self.pieces[i].replace(SPACE, " ").encode() for i in plain], [self.scores[i] for i in plain], plain)
        self.kind = "<u2" if n <= 1 << 16 else "<u4"
        silent = {i for i in range(n) if sp.is_control(i) or i == self.unk}
        raw = [b"" if i in silent else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.sizes = np.array([len(x) for x in raw], np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.of_byte = np.array([self.bytes.get(b, self.unk) for b in range(256)], np.int32)

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best segmentation of one word or text."""
        return self._long(s.replace(SPACE, " ").encode())

    def _long(self, raw: bytes) -> list[int]:
        """One word by itself, byte by byte."""
        auto, n = self.auto, len(raw)
        step, kind, first, link = auto.step, auto.kind.tolist(), auto.first, auto.link
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        state, begin = 0, 0
        for e in range(1, n + 1):
            b = raw[e - 1]
            if b & 0xC0 != 0x80:
                begin = e - 1
            state = int(step[state * auto.width + kind[b]])
            if e < n and raw[e] & 0xC0 == 0x80:
                continue
            o, alone, top, how = int(first[state]), False, -np.inf, (begin, -1)
            while o:
                size = int(auto.depth[o])
                alone |= size == e - begin
                new = best[e - size] + auto.score[o]
                if new > top:
                    top, how = new, (e - size, int(auto.piece[o]))
                o = int(link[o])
            if not alone and best[begin] + self.floor > top:
                top, how = best[begin] + self.floor, (begin, -1)
            best[e], back[e] = top, how
        out = []
        while n:
            start, i = back[n]
            out += [i] if i >= 0 else [int(x) for x in self.of_byte[list(raw[start:n])][::-1]] if self.bytes else [self.unk]
            n = start
        return out[::-1]

    def _together(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all words in a row, their number by word) of words of descending size."""
        auto, words, most = self.auto, len(start), int(size[0])
        best = np.full((most + 1) * words, -np.inf)
        best[:words] = 0.0
        came, by = np.zeros((most + 1) * words, np.int32), np.full((most + 1) * words, -1, np.int32)
        live = words - np.searchsorted(size[::-1], np.arange(1, most + 1))  # words that have a byte at each place
        state, begin = np.zeros(words, np.int32), np.zeros(words, np.int32)
        padded = np.append(raw, np.uint8(0))
        for t in range(most):
            k = int(live[t])
            b = raw[start[:k] + t]
            begin[:k] = np.where((b & 0xC0) != 0x80, t, begin[:k])
            state[:k] = auto.step[state[:k] * np.int64(auto.width) + auto.kind[b]]
            inside = (t + 1 < size[:k]) & ((padded[start[:k] + t + 1] & 0xC0) == 0x80)
            w = np.flatnonzero(~inside)  # a character ends here
            o = auto.first[state[w]]
            top, how, piece = np.full(len(w), -np.inf), begin[w], np.full(len(w), -1, np.int32)
            alone = np.zeros(len(w), bool)
            some = np.flatnonzero(o)
            while len(some):
                x = o[some]
                deep = auto.depth[x]
                alone[some] |= deep == t + 1 - begin[w[some]]
                new = best[(t + 1 - deep) * np.int64(words) + w[some]] + auto.score[x]
                better = new > top[some]
                at = some[better]
                top[at], how[at], piece[at] = new[better], t + 1 - deep[better], auto.piece[x[better]]
                o[some] = auto.link[x]
                some = some[o[some] > 0]
            other = np.flatnonzero(~alone)
            if len(other):
                new = best[begin[w[other]] * np.int64(words) + w[other]] + self.floor
                at = other[new > top[other]]
                top[at], how[at], piece[at] = new[new > top[other]], begin[w[at]], -1
            place = (t + 1) * np.int64(words) + w
            best[place], came[place], by[place] = top, how, piece
        # back from the ends: pieces by word and by step, then turned round
        owner, found = [], []
        w, e = np.arange(words), size.astype(np.int64).copy()
        while len(w):
            place = e * words + w
            piece, how = by[place], came[place]
            known = piece >= 0
            if known.all():
                owner.append(w)
                found.append(piece)
            elif self.bytes:  # the bytes of an unknown character, last first
                length = np.where(known, 1, e - how)
                for j in range(int(length.max())):
                    on = length > j
                    owner.append(w[on])
                    byte = self.of_byte[raw[np.minimum(start[w[on]] + e[on] - 1 - j, len(raw) - 1)]]
                    found.append(np.where(known[on], piece[on], byte))
            else:
                owner.append(w)
                found.append(np.where(known, piece, self.unk))
            go = how > 0
            w, e = w[go], how[go].astype(np.int64)
        owner, found = np.concatenate(owner)[::-1], np.concatenate(found)[::-1]
        order = np.argsort(owner, kind="stable")
        return found[order], np.bincount(owner, minlength=words)

    def segment(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all words in a row, their number by word) of binary words."""
        raw, at = text_bytes(words)
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        short = order[size[order] <= LONGEST]
        parts, counts, owners = [], np.zeros(len(words), np.int64), []
        for i in order[: len(order) - len(short)]:
            ids = self._long(raw[at[i] : at[i + 1]].tobytes())
            parts.append(np.array(ids, np.int32))
            counts[i] = len(ids)
            owners.append(np.array([i]))
        for i in range(0, len(short), TOGETHER):
            own = short[i : i + TOGETHER]
            ids, n = self._together(raw, at[own], size[own])
            parts.append(ids)
            counts[own] = n
            owners.append(own)
        if not parts:
            return np.zeros(0, np.int32), counts
        flat, own = np.concatenate(parts), np.concatenate(owners)
        # from the order of sizes to the order of words
        begins = np.empty(len(words), np.int64)
        begins[own] = np.cumsum(counts[own]) - counts[own]
        return flat[spread(begins, counts)], counts

    def encode_all(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of all texts in a row, their number by text, the bytes that they stand for, their number by text)."""
        text = text.cast(pa.string()).fill_null("")
        if pc.any(pc.match_substring(text, SPACE)).as_py():
            text = pc.replace_substring(text, SPACE, " ")
        raw, at = text_bytes(text)
        size = np.diff(at)
        some = size > 0
        full = size + some  # with a blank before
        ends = np.cumsum(full)
        out = np.full(int(ends[-1]) if len(ends) else 0, BLANK, np.uint8)
        out[np.arange(len(raw)) + np.repeat(np.cumsum(some), size)] = raw
        first = (ends - full)[some]
        if self.by_words:
            blank = out == BLANK
            begin = blank.copy()
            begin[1:] &= ~blank[:-1]
            begin[first] = True
            start = np.flatnonzero(begin)
        else:
            start = first
        offsets = np.append(start, len(out)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).dictionary_encode()
        ids, n = self.segment(words.dictionary)
        which = words.indices.to_numpy()
        count = n[which]
        flat = ids[spread((np.cumsum(n) - n)[which], count)]
        per_text = np.zeros(len(text), np.int64)
        if len(first):
            per_text[some] = np.add.reduceat(count, np.searchsorted(start, first))
        return flat, per_text, out, full

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0].astype(self.kind)

    def spelt(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the pieces in a row, their number by piece); byte pieces and text pieces take the same path."""
        size = self.sizes[ids]
        return self.raw[spread(self.starts[ids], size)], size

    def decode(self, ids: list[int]) -> str:
        text = self.spelt(np.array(ids, np.int64))[0].tobytes().decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


_made: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for a worker: its automaton lasts over tasks."""
    if path not in _made:
        _made[path] = Codec(path)
    return _made[path]


def normalized(text: str | None) -> str:
    return (text or "").replace(SPACE, " ")


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat.astype(np.int32))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, text_crc32, n_pieces, ids); text_crc32 is of the text that decoding should give."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                part = batch.column(1).slice(a, b - a)
                flat, counts, _, _ = c.encode_all(part)
                crc = pa.array([zlib.crc32(normalized(t).encode()) for t in part.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), crc, pa.array(counts.astype(np.int32)), _lists(flat, counts)], ["doc_id", "text_crc32", "n_pieces", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, text_crc32 long, n_pieces int, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """rows (doc_id, text_crc32, n_pieces, ids) with decoded, the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = [c.decode(x.values.to_numpy()) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return rows.mapInArrow(scan, "doc_id long, text_crc32 long, n_pieces int, ids array<int>, decoded string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids, same): same says that the ids decode to the text. Both ways in one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                flat, counts, wanted, sizes = c.encode_all(batch.column(1).slice(a, b - a))
                got, lengths = c.spelt(flat)
                if np.array_equal(got, wanted):
                    same = np.ones(b - a, bool)
                else:  # text by text
                    to, own = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, np.add.reduceat(np.append(lengths, 0), np.cumsum(counts) - counts) * (counts > 0)))
                    same = np.array([np.array_equal(got[own[i] : own[i + 1]], wanted[to[i] : to[i + 1]]) for i in range(b - a)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int32)), _lists(flat, counts), pa.array(same)], ["doc_id", "n_pieces", "ids", "same"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_pieces int, ids array<int>, same boolean")
