"""Line dedup: an exact set-similarity join of the lines of all documents. Tokens, prefixes and sketches are made in
Arrow batches, as the interpreted array functions missed the limits.

A line's tokens are its distinct words (lower case, parted by the six ASCII blanks), told apart by 64-bit hashes. Lines of
percent / 100 Jaccard or more match; of two that match the later one, by (doc_id, row, line number), is removed, whether or not the
earlier one stays.

1. Words are counted over all documents in BUCKETS hashed buckets, a table of one byte each (the count's logarithm). Tasks hand over
   CHUNK counts a row. Tokens of all lines are sorted by the table, rarest first. Any one order keeps the join exact; this one keeps prefixes rare.
2. Lines of equal token sets (equal size and two 64-bit sums over the hashes) are one class, named by the place of its first line.
3. Similar classes of n tokens share one among the n - ceil(n percent / 100) + 1 rarest of each, the prefix. The first one that they share is
   either cold, with a bucket's count under 2^HOT, or hot, and then all that they share are hot. Cold tokens of the prefix are keys.
   Where a prefix has hot tokens, neighbours among the hot tokens of a longer prefix are keys, in pairs: of d + 1 shared tokens in
   a row, d pairs, each token that is not shared parts at most one, and there are at most a + b - 2 o of these (o: the least overlap
   of sizes a and b). One pair more is left whole. So a line has at most about 0.4 n keys, at any size of corpus. A key is used
   towards sets of no fewer tokens, of no more, or both, as far as enough tokens are hot: lines of one template with rare tokens of
   their own share keys, but meet no lines of their size.
4. A cold key has fewer than 2^HOT classes, so cold keys meet in Arrow tasks, in blocks that are dealt by key, which compare up to
   CROWD classes. Pair keys have no such bound: they, and cold keys of more classes, meet in a join that Spark can split. There,
   classes of keys that more than LEAD share are first compared with the earliest class of each such key, then with the earliest of each of
   LEADERS parts of it (ROUNDS rounds): what matches is settled and stands back, so that large groups of near copies need few pairs among
   themselves. Their rows have sketches of 1024 bits, made of the token sets that this needs anyway. Blocks of cold keys give one
   pair a class at first, with the earliest class that it may match; only classes that had more and are not settled by it meet again,
   with all others. This only saves work: what is not settled is compared with all.
5. Of classes that meet, those stay that pass the length filter, the positional filter (what can still be common) and the parity
   sketch (two token sets differ in at least as many tokens as their sketches in bits). A sketch of few bits lets all pairs of long
   sets pass, similar or not, so it has 64 bits, 128 from MIDDLE tokens, and in blocks of cold keys 256 from LONG tokens, 512 from twice
   as many and 1024 from four times. A longer one is folded to a shorter one by the exclusive or of its words.
6. What stays is verified on full token sets, which another pass makes of the lines that are named in pairs.

Lines without words are never removed and match nothing. A null text stays null. Null ids come first in the order, with the least
long. Each row is a document of its own, also where ids are null or repeat: lines are kept by row numbers (common.numbered), which order rows
of one id. An empty table gives no rows. Columns besides doc_id and text are kept by deduplicated and not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import BLANK_WORDS, STEP, discard, free_name, mix, numbered, slices, stash, text_bytes, trim

BUCKETS, CHUNK, HOT = 1 << 21, 1 << 12, 12
CROWD, LEAD, ROUNDS, LEADERS = 512, 32, 2, 32
#: Text bytes that are tokenized at once: their arrays stay in a core's cache.
BLOCK = 1 << 17
#: A line's place is its row number and its number in the row.
PLACE_BITS = 28
#: Words of the longest sketch, and tokens from which sets have two words, and that one.
WORDS, MIDDLE, LONG = 16, 64, 192
#: Cold keys are compared by their first bits; the size of a set fills the 64. Words that share these stay apart when pairs are verified.
HASH_BITS = 39
#: Cold keys of a block, pairs that are looked at together, and those of them whose longest sketches are.
PART_KEYS, PAIRS, WIDE = 1 << 19, 1 << 18, 1 << 14
#: Sizes of sets are told apart so many to a doubling where keys are filtered.
BANDS = 8
#: Bits of the filter of wanted lines: about 16 a line, in chunks; more lines than it can hold only let other lines pass.
FILTER_BITS = 1 << 27
LEAST = -(1 << 63)


def lowered(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col)


def _hashed_lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each line, number of each line in its row, word hashes, first word of each line and the number of words)."""
    raw, starts, row, number = _lines(col)
    h, first = BLANK_WORDS.hashes(raw, np.append(starts, len(raw)))
    return row, number, h, first


def _lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each line, its row, its number in the row)."""
    raw, at = text_bytes(col)
    breaks = np.flatnonzero(raw == 10) + 1
    # a row begins a line even where it is empty: rows come before the breaks at the same place, as stable sorting leaves them
    starts = np.concatenate([at[:-1], breaks])
    row = np.concatenate([np.arange(len(col)), np.searchsorted(at, breaks - 1, side="right") - 1])
    order = np.lexsort((starts, row))
    row, starts = row[order], starts[order]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    if len(number) and number.max() >> PLACE_BITS:
        raise ValueError(f"a text of more than 2^{PLACE_BITS} lines")
    return raw, starts, row, number


def chunked(df: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], np.ndarray], merged: Callable[[np.ndarray], np.ndarray], kind: str, size: int, join: np.ufunc = np.add) -> np.ndarray:
    """Sums (or another join) over tasks: made gives a task's table of size numbers (kind), handed over CHUNK numbers a row where they
    are not all 0; merged makes the bytes that the driver gets, size of them at most, from the rows' sums."""

    def rows(table: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(ids, pa.int32()), "n": pa.array([x.tobytes() for x in table], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = made(batches).reshape(-1, CHUNK)
        some = np.flatnonzero(table.any(axis=1))
        if len(some):
            yield from rows(table[some], some)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = total.setdefault(chunk, np.zeros(CHUNK, np.int64))
                join(own, np.frombuffer(n, kind), out=own, casting="unsafe")
        if total:
            yield from rows(merged(np.array(list(total.values()))), np.array(list(total)))

    schema = "chunk int, n binary"
    got = df.mapInArrow(count, schema).repartition("chunk").mapInArrow(merge, schema).toArrow()
    table = np.zeros((size // CHUNK, CHUNK), np.uint8)
    for chunk, n in zip(got.column("chunk").to_pylist(), got.column("n").to_pylist(), strict=True):
        table[chunk] = np.frombuffer(n, np.uint8)
    return table.ravel()


def rarity(docs: DataFrame) -> bytes:
    """BUCKETS bytes: the logarithm of the number of words of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for a, b in slices(batch.column(0), BLOCK):
                h, _ = BLANK_WORDS.hashes(*text_bytes(lowered(batch.column(0).slice(a, b - a))))
                np.add.at(n, (h & np.uint64(BUCKETS - 1)).astype(np.int64), np.uint32(1))
        return n

    return chunked(docs.select("text"), count, lambda n: np.log2(np.maximum(n, 1)).astype(np.uint8), "<u4", BUCKETS).tobytes()


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    return (n * percent + 99) // 100


@lru_cache(1 << 16)
def prefixes(a: int, percent: int) -> tuple[int, int]:
    """Of a set of a tokens: the prefixes that similar other sets of no more tokens, and of no fewer tokens, meet."""
    large, small = _partners(a, percent)
    return tuple(int((a - o + 1).max()) if len(o) else 0 for _, o in (large, small))


@lru_cache(1 << 16)
def hot_prefixes(a: int, cold: int, percent: int) -> tuple[int, int]:
    """As prefixes, if all tokens that they share are hot, and cold of the a are not: the longer prefixes in which two neighbours meet."""
    out = []
    for b, o in _partners(a, percent):
        some = o <= a - cold  # else too few are hot
        out.append(int((2 * a + b - 3 * o + 2)[some].max()) if some.any() else 0)
    return out[0], out[1]


@lru_cache(1 << 12)
def _partners(a: int, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sizes b, least overlaps) of the similar other sets of no more tokens, and of no fewer."""
    b = np.arange(int(needed(np.int64(a), percent)), a * 100 // percent + 1, dtype=np.int64)
    o = -(-percent * (a + b) // (100 + percent))
    other = (o <= np.minimum(a, b)) & ((a != b) | (o < a))
    return [(b[x], o[x]) for x in (other & (b <= a), other & (b >= a))]


def by_size(f: Callable, *columns: np.ndarray) -> np.ndarray:
    """(2, rows): f of each row of one or two columns, which is computed once for equal rows."""
    if not len(columns[0]):
        return np.zeros((2, 0), np.int64)
    code = columns[0].astype(np.int64)
    for c in columns[1:]:
        code = code << 32 | c
    rows, own = np.unique(code, return_inverse=True)
    cut = lambda r: (r >> 32, r & 0xFFFFFFFF) if len(columns) > 1 else (r,)
    return np.array([f(*cut(r)) for r in rows.tolist()], np.int64).T[:, own]


def token_sets(h: np.ndarray, first: np.ndarray, level: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, their levels, lines with tokens, the first token of each): the tokens of each line once, by level and hash."""
    line = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lv = level[(h & np.uint64(len(level) - 1)).astype(np.int64)] if level is not None else np.zeros(len(h), np.uint8)
    # as one number: level, line and most of the hash; where that can't tell two tokens apart, by all of them
    lines = max(1, len(first) - 1).bit_length()
    order = np.argsort(line.astype(np.uint64) << np.uint64(64 - lines) | lv.astype(np.uint64) << np.uint64(59 - lines) | h >> np.uint64(5 + lines)) if lines < 30 else np.lexsort((h, lv, line))
    alike = lambda x: x[order[1:]] == x[order[:-1]]
    if lines < 30 and (alike(lv) & alike(line) & (h[order[1:]] < h[order[:-1]])).any():
        order = np.lexsort((h, lv, line))
    new = np.ones(len(order), bool)
    new[1:] = ~(alike(h) & alike(line))
    order = order[new]
    line = line[order]
    edge = np.ones(len(line), bool)
    np.not_equal(line[1:], line[:-1], out=edge[1:])
    start = np.flatnonzero(edge)
    return h[order], lv[order], line[start], start


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary for each count: so many of the 64-bit values."""
    ends = np.concatenate([[0], np.cumsum(counts) * 8]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def widths(n: np.ndarray) -> np.ndarray:
    """Words of the longest sketch of sets of n tokens: a quarter of WORDS from LONG tokens, a half from twice as many, all from four times."""
    return np.select([n < LONG, n < 2 * LONG, n < 4 * LONG], [0, WORDS // 4, WORDS // 2], WORDS)


def padded(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(rows, WORDS): the longest sketches of sets of n tokens, LONG or more, one after another in words; 0 behind short ones."""
    out = np.zeros((len(n), WORDS), np.uint64)
    out[np.arange(WORDS) < widths(n)[:, None]] = words
    return out


def unpadded(full: np.ndarray, n: np.ndarray) -> bytes:
    """What padded takes: full has a row for each of the sets that has LONG tokens."""
    return full[np.arange(WORDS) < widths(n[n >= LONG])[:, None]].tobytes()


def sketches(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> dict[str, pa.Array]:
    """Parity sketches of token sets: s1, all words of a sketch folded to one; s2, its odd words, from MIDDLE tokens, else 0; and
    sketch, its words folded to as many as widths tells."""
    word, bit = (h >> np.uint64(60)).astype(np.int64), np.uint64(1) << (h >> np.uint64(54) & np.uint64(63))
    fold = lambda some: np.bitwise_xor.reduceat(some, start)
    s2 = np.where(n >= MIDDLE, fold(np.where(word & 1, bit, np.uint64(0))), np.uint64(0))
    long = n >= LONG
    of, some = np.repeat(np.cumsum(long) - 1, n), np.repeat(long, n)
    full = np.zeros((int(long.sum()), WORDS), np.uint64)
    wide = widths(n)
    np.bitwise_xor.at(full, (of[some], word[some] & (np.repeat(wide, n)[some] - 1)), bit[some])
    full = full[np.arange(WORDS) < wide[long][:, None]]
    return {"s1": pa.array(fold(bit).view(np.int64)), "s2": pa.array(s2.view(np.int64)), "sketch": binaries(full, wide)}


def line_arrays(col: pa.Array, table: np.ndarray, percent: int) -> dict[str, pa.Array]:
    """The lines with words of some texts: row, line_no, h1, h2 (two hashes of the token set), n (tokens), s1, s2 and sketch (see
    sketches), cold and hot (keys; a key's place among both is the place of its token, or of the first of its two, in the line)."""
    row, number, h, first = _hashed_lines(col)
    h, level, lines, start = token_sets(h, first, table)
    n = np.diff(np.append(start, len(h)))
    if not len(n):
        return {}
    prefix = by_size(lambda a: prefixes(a, percent), n).max(axis=0)
    of = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(h)) - start[of]
    cool = level < HOT
    cold = cool & (pos < prefix[of])
    colds = np.add.reduceat(cool.astype(np.int64), start)
    longer = by_size(lambda a, c: hot_prefixes(a, c, percent), n, colds).max(axis=0)
    pair = np.zeros(len(h), bool)
    pair[:-1] = ~cool[:-1] & (pos[:-1] + 1 < longer[of[:-1]]) & (of[1:] == of[:-1])
    pair &= (colds < prefix)[of]
    at = np.flatnonzero(pair)
    count = lambda some: np.add.reduceat(some.astype(np.int64), start)
    return {
        "row": pa.array(row[lines]),
        "line_no": pa.array(number[lines].astype(np.int32)),
        "h1": pa.array(np.add.reduceat(mix(h), start).view(np.int64)),
        "h2": pa.array(np.add.reduceat(mix(h ^ np.uint64(STEP)), start).view(np.int64)),
        "n": pa.array(n.astype(np.int32)),
        **sketches(h, start, n),
        "cold": binaries(h[cold], count(cold)),
        "hot": binaries(mix(mix(h[at]) * np.uint64(STEP) + h[at + 1]), count(pair)),
    }


LINES = "d long, doc_row long, line_no int, h1 long, h2 long, n int, s1 long, s2 long, sketch binary, cold binary, hot binary"


def place(row: Column, line_no: Column) -> Column:
    """One number a line, ascending by row and line."""
    return F.shiftleft(row, PLACE_BITS).bitwiseOR(line_no.cast("long"))


def lines_of(docs: DataFrame, percent: int) -> DataFrame:
    """LINES of docs (d, text, doc_row): a row a line with words."""
    levels = rarity(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(levels, np.uint8)
        for batch in batches:
            for a, b in slices(batch.column(1), BLOCK):
                got = line_arrays(lowered(batch.column(1).slice(a, b - a)), table, percent)
                if got:
                    own = got.pop("row")
                    ids, rows = (batch.column(c).slice(a, b - a).take(own) for c in (0, 2))
                    yield pa.RecordBatch.from_pydict({"d": ids, "doc_row": rows} | got)
        trim()

    return docs.select("d", "text", "doc_row").mapInArrow(scan, LINES)


def classes(wide: DataFrame) -> DataFrame:
    """A row a distinct token set of wide (LINES): the place at and the id d of its first line, the number of lines, its keys."""
    # all lines of a class have the same arrays: as grouping keys, and order as one number, they keep the aggregation hashed
    whole = lambda c: c.cast("decimal(20,0)")
    span = whole(F.lit(1 << 62)) * 2
    order = (whole(F.col("d")) * span).cast("decimal(38,0)") + whole(place(F.col("doc_row"), F.col("line_no")))
    once = wide.groupBy("h1", "h2", "n", "s1", "s2", "sketch", "cold", "hot").agg(F.min(order.cast("decimal(38,0)")).alias("first"), F.min("d").alias("d"), F.count(F.lit(1)).alias("lines"))
    return once.select("h1", "h2", "n", "s1", "s2", "sketch", "cold", "hot", "d", "lines", F.pmod("first", span).cast("long").alias("at"))


def keys_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row of each, its number in the row) of a binary column."""
    raw, at = text_bytes(col)
    count = np.diff(at) // 8
    own = np.repeat(np.arange(len(col)), count)
    return raw.view(np.uint64), own, np.arange(len(own)) - (at[:-1] // 8)[own]


#: d is kept less the row number: where ids follow the rows, that is one number.
COLD = np.dtype([("key", "<u8"), ("d", "<i8"), ("at", "<i8"), ("s1", "<u8"), ("s2", "<u8"), ("n", "<u4"), ("pos", "<u4"), ("open", "u1")])


def planes(x: np.ndarray) -> bytes:
    """rows (COLD) byte by byte of all rows: most bytes of numbers are 0, and the shuffle compresses runs."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), COLD.itemsize).T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(COLD.itemsize, -1).T).view(COLD).ravel()


def first_bits(key: np.ndarray) -> np.ndarray:
    low = np.uint64(64 - HASH_BITS)
    return key >> low << low


def crowded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in x (COLD) of keys with at most CROWD rows, and of those with more."""
    order = np.argsort(x["key"])
    key = x["key"][order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(x) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(x)))
    many = np.repeat(count > CROWD, count)
    return order[~many], order[many]


def met(x: np.ndarray, full: np.ndarray, percent: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """((pairs, 2) places, the earlier class first, of the rows (COLD) that share a key's first HASH_BITS bits and pass the filters;
    whether the later class has more pairs). full: a sketch of WORDS words for each row of LONG or more tokens. With first, the
    earliest pair of each later class; without, all pairs of later classes that are open."""
    sized = lambda n: np.minimum(n, (1 << (64 - HASH_BITS)) - 1).astype(np.uint64)
    key = first_bits(x["key"])
    code = key | sized(x["n"])
    order = np.argsort(code)
    spot = (np.cumsum(x["n"] >= LONG) - 1)[order]
    x, key, code = x[order], key[order], code[order]
    # by key and size: a row's partners are the next ones, up to the size that the length filter lets pass
    ends = np.searchsorted(code, key | sized(x["n"].astype(np.int64) * 100 // percent), side="right")
    many = ends - np.arange(1, len(x) + 1)
    total = np.concatenate([[0], np.cumsum(many)])
    out, done = [], 0
    n, pos, s1, s2, place_of = x["n"].astype(np.int64), x["pos"].astype(np.int64), x["s1"], x["s2"], x["at"]
    while done < len(x):
        upto = max(done + 1, int(np.searchsorted(total, total[done] + PAIRS, side="right")) - 1)
        a = np.repeat(np.arange(done, upto), many[done:upto])
        b = a + 1 + np.arange(len(a)) - (total[done:upto] - total[done])[a - done]
        done = upto
        both = n[a] + n[b]
        ok = (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) * (100 + percent) >= both * percent)
        a, b, both = a[ok], b[ok], both[ok]
        few = lambda bits, both: bits * (100 + percent) <= both * (100 - percent)
        ok = few(np.bitwise_count(s1[a] ^ s1[b]).astype(np.int64), both) & (place_of[a] != place_of[b])
        a, b, both = a[ok], b[ok], both[ok]
        odd = np.where((n[a] >= MIDDLE) & (n[b] >= MIDDLE), s2[a] ^ s2[b], np.uint64(0))
        ok = few(np.bitwise_count(s1[a] ^ s1[b] ^ odd).astype(np.int64) + np.bitwise_count(odd), both)
        a, b, both = a[ok], b[ok], both[ok]
        ok, least = np.ones(len(a), bool), widths(np.minimum(n[a], n[b]))
        for width in (WORDS // 4, WORDS // 2, WORDS):
            wide = np.flatnonzero(least == width)
            for some in np.split(wide, range(WIDE, len(wide), WIDE)):
                differ = np.bitwise_xor.reduce((full[spot[a[some]]] ^ full[spot[b[some]]]).reshape(-1, WORDS // width, width), axis=1)
                ok[some] = few(np.bitwise_count(differ).sum(axis=1, dtype=np.int64), both[some])
        a, b = a[ok], b[ok]
        later = (x["d"][a] > x["d"][b]) | ((x["d"][a] == x["d"][b]) & (place_of[a] > place_of[b]))
        a, b = np.where(later, b, a), np.where(later, a, b)
        if not first:
            some = x["open"][b] > 0
            a, b = a[some], b[some]
        out.append(np.stack([place_of[b], place_of[a]], 1))
    if not out:
        return np.zeros((0, 2), np.int64), np.zeros(0, bool)
    got = np.unique(np.concatenate(out), axis=0)[:, ::-1]
    if not first:
        return got, np.zeros(len(got), bool)
    start = np.flatnonzero(np.concatenate([[True], got[1:, 1] != got[:-1, 1]])) if len(got) else np.zeros(0, np.int64)
    return got[start], np.diff(np.append(start, len(got))) > 1


def marked(places: DataFrame, count: int) -> tuple[bytes, int]:
    """(a filter of the places in all columns, about count of them; its bits). It has all of them, and some others."""
    bits = min(FILTER_BITS, 8 * CHUNK << max(0, (2 * count // CHUNK).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(bits, bool)
        for batch in batches:
            for c in batch.columns:
                out[_spots(c.to_numpy(), bits)] = True
        return np.packbits(out, bitorder="little")

    return chunked(places, mark, lambda n: n.astype(np.uint8), "u1", bits // 8, np.bitwise_or).tobytes(), bits


def _spots(at: np.ndarray, bits: int) -> np.ndarray:
    return (mix(at.view(np.uint64) + np.uint64(STEP)) % np.uint64(bits)).astype(np.int64)


def has(marks: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    spot = _spots(at, bits)
    return (marks[spot >> 3] >> (spot & 7).astype(np.uint8) & 1) > 0


def banded(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Keys with the logarithm of a size in the bits that first_bits leaves free."""
    return first_bits(key) + (BANDS * np.log2(n)).astype(np.uint64)


def cold_meetings(sets: DataFrame, percent: int, again: DataFrame | None = None) -> DataFrame:
    """(a, b, more, pos, d, n, s1, s2): pairs of classes, a the earlier, that share a cold key and pass the filters (pos null), of each block
    and b the one with the earliest a, and whether there are more; and for cold keys of more than CROWD classes key, class, its place (pos) and columns. With
    again (at): all pairs of these classes b, and of some others, but for keys of more than CROWD classes. Keys are dealt by a hash, in
    blocks of bytes, as a row a key would cost more than the work on it."""
    spark = sets.sparkSession
    n = sets.agg(F.sum(F.octet_length("cold") / 8)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n / PART_KEYS) + 1)
    parts = min(4 * tasks, 1 << 31)
    opened = keys = reach = None
    first = again is None
    if not first:
        # as few others as are asked for: all classes are looked up in the filter
        opened = marked(again, max(again.count(), sets.count() // 2))
        reach = int(BANDS * np.log2(100 / percent)) + 2

        def keys_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = np.frombuffer(opened[0], np.uint8)
            for batch in batches:
                some = has(marks, opened[1], batch.column(0).to_numpy())
                key, own, _ = keys_of(batch.column(2).filter(pa.array(some)))
                sized = banded(key, batch.column(1).to_numpy()[some][own])
                yield pa.RecordBatch.from_pydict({"key": pa.array((sized[:, None] + np.arange(2 * reach + 1, dtype=np.uint64)).ravel().view(np.int64))})

        wanted = stash(sets.select("at", "n", "cold").mapInArrow(keys_at, "key long"), "line-keys")
        keys = marked(wanted, wanted.count())
        discard(wanted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, open_keys = (np.frombuffer(x[0], np.uint8) if x else None for x in (opened, keys))
        for batch in batches:
            key, own, pos = keys_of(batch.column(6))
            key = first_bits(key)
            if keys:
                some = has(open_keys, keys[1], banded(key, batch.column(2).to_numpy()[own]) + np.uint64(reach))
                key, own, pos = key[some], own[some], pos[some]
            if not len(key):
                continue
            x = np.zeros(len(key), COLD)
            x["key"], x["pos"] = key, pos
            x["d"], x["at"], x["n"] = (batch.column(c).to_numpy()[own] for c in (0, 1, 2))
            x["d"] -= x["at"] >> PLACE_BITS
            x["s1"], x["s2"] = (batch.column(c).to_numpy().view(np.uint64)[own] for c in (3, 4))
            if opened:
                x["open"] = has(marks, opened[1], batch.column(1).to_numpy())[own]
            size = batch.column(2).to_numpy()
            long = np.cumsum(size >= LONG) - 1
            full = padded(text_bytes(batch.column(5))[0].view(np.uint64), size[size >= LONG])
            part = ((x["key"] >> np.uint64(64 - HASH_BITS)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            order = np.lexsort((x["n"], part))
            x, own, part = x[order], own[order], part[order].astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            ranges = list(zip(cut[:-1], cut[1:], strict=True))
            wide = [unpadded(full[long[own[a:b]][x["n"][a:b] >= LONG]], x["n"][a:b]) for a, b in ranges]
            yield pa.RecordBatch.from_pydict({"part": pa.array(part[cut[:-1]]), "rows": pa.array([planes(x[a:b]) for a, b in ranges], pa.binary()), "full": pa.array(wide, pa.binary())})
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wide, part = [], [], None

        def pairs() -> pa.RecordBatch:
            x = np.concatenate(held)
            x["d"] += x["at"] >> PLACE_BITS
            full = padded(np.frombuffer(b"".join(wide), np.uint64), x["n"][x["n"] >= LONG])
            few, many = crowded(x)
            spot, some = np.cumsum(x["n"] >= LONG) - 1, few[x["n"][few] >= LONG]
            got, more = met(x[few], full[spot[some]], percent, first)
            many = x[many if first else many[:0]]
            a, b = (np.concatenate([got[:, i], y]) for i, y in ((0, many["key"].view(np.int64)), (1, many["at"])))
            none = np.arange(len(a)) < len(got)
            own = {c: pa.array(np.concatenate([np.zeros(len(got), kind), many[c].astype(kind)]), mask=none) for c, kind in (("pos", "i4"), ("d", "i8"), ("n", "i4"), ("s1", "i8"), ("s2", "i8"))}
            return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "more": pa.array(np.concatenate([more, np.zeros(len(many), bool)]))} | own)

        for batch in batches:
            for p, rows, full in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if p != part and held:
                    yield pairs()
                    held, wide = [], []
                part = p
                held.append(unplaned(rows))
                wide.append(full)
        if held:
            yield pairs()
        trim()

    dealt = sets.select("d", "at", "n", "s1", "s2", "sketch", "cold").mapInArrow(deal, "part long, rows binary, full binary")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(meet, "a long, b long, more boolean, pos int, d long, n int, s1 long, s2 long")


HOT_KEYS = "key long, d long, at long, n int, pos int, s1 long, s2 long, small boolean, large boolean"


def hot_keys(sets: DataFrame, percent: int) -> DataFrame:
    """HOT_KEYS: a row a pair key; small and large tell whether it is used towards sets of no fewer, and of no more, tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, own, pos = keys_of(batch.column(6))
            colds = np.diff(text_bytes(batch.column(5))[1]) // 8  # all cold tokens, as fewer than the prefix are cold
            pos = pos + colds[own]
            large, small = by_size(lambda a, c: hot_prefixes(a, c, percent), batch.column(2).to_numpy().astype(np.int64), colds)
            rows = pa.array(own)
            take = lambda c: batch.column(c).take(rows)
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array(key.view(np.int64)), "d": take(0), "at": take(1), "n": take(2), "pos": pa.array(pos.astype(np.int32)), "s1": take(3),
                 "s2": take(4), "small": pa.array(pos + 1 < small[own]), "large": pa.array(pos + 1 < large[own])}
            )

    some = sets.where(F.octet_length("hot") > 0)
    return some.select("d", "at", "n", "s1", "s2", "cold", "hot").mapInArrow(scan, HOT_KEYS)


def crowd_keys(meetings: DataFrame, percent: int) -> DataFrame:
    """HOT_KEYS of the cold keys that more than CROWD classes share."""
    rows = meetings.where("pos IS NOT NULL").select(F.col("a").alias("key"), "d", F.col("b").alias("at"), "n", "pos", "s1", "s2")
    n = F.col("n").cast("long")
    of_own_size = n - F.ceil(n * 2 * percent / (100 + percent)) + 1  # the least overlap with a set of no fewer tokens is that with one of as many
    return rows.select("key", "d", "at", "n", "pos", "s1", "s2", (F.col("pos") < of_own_size).alias("small"), F.lit(True).alias("large"))


def bits(words: Iterable[tuple[Column, Column]]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in words])


def fits(a: str, b: str, percent: int, long: bool = False) -> Column:
    """The length filter and the parity sketch of rows a and b; with long, that of LONG_SKETCH."""
    na, nb = (F.col(f"{x}.n").cast("long") for x in (a, b))
    if long:
        differ = bits((F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in LONG_SKETCH)
    else:
        odd = F.when((na >= MIDDLE) & (nb >= MIDDLE), F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2"))).otherwise(F.lit(0).cast("long"))
        differ = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1")).bitwiseXOR(odd)) + F.bit_count(odd)
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (differ * (100 + percent) <= (na + nb) * (100 - percent))


def crowd_of(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of keys that more than LEAD classes share, a stashed table, and the others."""
    heavy = stash(hot.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LEAD).select("key"), "line-heavy")
    return stash(hot.join(heavy, "key").select(hot.columns), "line-crowd"), hot.join(heavy, "key", "left_anti")


#: Columns of the sketches that rows of crowded keys get from their token sets.
LONG_SKETCH = [f"t{i}" for i in range(WORDS)]


def long_sketches(words: DataFrame) -> DataFrame:
    """(at, LONG_SKETCH) of token sets (at, w): those of 64 bits let many pairs pass of a group of near copies that differ too much."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = batch.column(1).flatten().to_numpy().view(np.uint64), batch.column(1).value_lengths().to_numpy()
            full = np.zeros((len(n), WORDS), np.uint64)
            np.bitwise_xor.at(full, (np.repeat(np.arange(len(n)), n), (h >> np.uint64(60)).astype(np.int64)), np.uint64(1) << (h >> np.uint64(54) & np.uint64(63)))
            yield pa.RecordBatch.from_pydict({"at": batch.column(0)} | {c: pa.array(full[:, i].view(np.int64)) for i, c in enumerate(LONG_SKETCH)})

    return words.select("at", "w").mapInArrow(scan, ", ".join(["at long", *(f"{c} long" for c in LONG_SKETCH)]))


def settled_by_leaders(crowd: DataFrame, words: DataFrame, percent: int) -> DataFrame | None:
    """(at) of classes that match an early class of a key of crowd, by the token sets words, a stashed table; None without any. In each round
    the classes of a key that are left are dealt by a hash, in more parts each time, and all are compared with the earliest of each part."""
    settled, live = None, crowd
    for i in range(ROUNDS):
        part = F.pmod(F.xxhash64("at", F.lit(i)), F.lit(LEADERS**i))
        heavy = live.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LEAD).select("key")
        lead = live.groupBy("key", part.alias("part")).agg(F.min(F.struct("d", "at", "n", *LONG_SKETCH)).alias("a"))
        later = (F.col("a.d") < F.col("b.d")) | ((F.col("a.d") == F.col("b.d")) & (F.col("a.at") < F.col("b.at")))
        both = live.alias("b").join(lead.join(heavy, "key", "left_semi").select("key", "a").alias("h"), "key").where(later & fits("a", "b", percent, long=True))
        # a leader that is late has few to lead; the earliest that fits is verified
        first = both.groupBy(F.col("b.at").alias("b")).agg(F.min(F.struct("a.d", "a.at")).alias("a")).select("a.at", "b").withColumnRenamed("at", "a")
        new = stash(later_of(first, words, percent), "line-settled")
        if settled is None:
            settled = new
        else:
            old, settled = settled, stash(settled.union(new), "line-settled")
            discard(old, new)
        live = crowd.join(settled, "at", "left_anti").select(crowd.columns)
    return settled


def hot_pairs(hot: DataFrame, settled: DataFrame | None, percent: int, long: bool = False) -> DataFrame:
    """(a, b): classes that share a key and pass the filters, a the earlier, b not settled."""
    small, large = hot.where("small"), hot.where("large")
    na, nb, pa_, pb = (F.col(x).cast("long") for x in ("a.n", "b.n", "a.pos", "b.pos"))
    most = F.least(pa_, pb) + F.least(na - pa_, nb - pb)
    on = (F.col("a.key") == F.col("b.key")) & (na <= nb) & (F.col("a.at") != F.col("b.at")) & (most * (100 + percent) >= (na + nb) * percent) & fits("a", "b", percent, long)
    b_later = (F.col("a.d") < F.col("b.d")) | ((F.col("a.d") == F.col("b.d")) & (F.col("a.at") < F.col("b.at")))
    left = lambda t: t if settled is None else t.join(settled, "at", "left_anti").select(t.columns)
    one = small.alias("a").join(left(large).alias("b"), on & b_later).select(F.col("a.at").alias("a"), F.col("b.at").alias("b"))
    return one.union(left(small).alias("a").join(large.alias("b"), on & ~b_later).select(F.col("b.at").alias("a"), F.col("a.at").alias("b")))


def token_rows(docs: DataFrame, named: DataFrame, count: int) -> DataFrame:
    """(at, w): the token sets of the lines at the places that named has in its columns, about count of them, and of some others."""
    marks, bits = marked(named, count)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marks, np.uint8)
        for batch in batches:
            for a, b in slices(batch.column(0), BLOCK):
                raw, starts, row, number = _lines(batch.column(0).slice(a, b - a))
                doc = batch.column(1).slice(a, b - a).to_numpy()
                at = (doc[row] << PLACE_BITS) | number
                some = np.flatnonzero(has(table, bits, at))
                if not len(some):
                    continue
                ends = np.append(starts, len(raw))
                own = np.concatenate([raw[starts[i] : ends[i + 1]] for i in some])
                offsets = np.concatenate([[0], np.cumsum(ends[some + 1] - starts[some])])
                own = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(offsets), pa.py_buffer(own))
                h, first = BLANK_WORDS.hashes(*text_bytes(lowered(own)))
                h, _, lines, start = token_sets(h, first, None)
                lists = pa.ListArray.from_arrays(np.append(start, len(h)).astype(np.int32), h.view(np.int64))
                of = some[lines]
                yield pa.RecordBatch.from_pydict({"at": pa.array(at[of]), "w": lists})
        trim()

    return docs.select("text", "doc_row").mapInArrow(scan, "at long, w array<long>")


def later_of(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """(at) of the classes b of pairs (a, b) that match their a, by the token sets words (at, w)."""
    side = lambda c: words.select(F.col("at").alias(c), F.col("w").alias(f"w{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    inter = F.size(F.array_intersect("wa", "wb"))
    same = inter * 100 >= (F.size("wa") + F.size("wb") - inter) * percent
    return both.where(same).select(F.col("b").alias("at")).distinct()


def both_of(*tables: DataFrame | None) -> DataFrame | None:
    """The rows of stashed tables (at), which are deleted, as a stashed table."""
    some = [t for t in tables if t is not None]
    if len(some) < 2:
        return some[0] if some else None
    out = some[0]
    for t in some[1:]:
        out = out.union(t)
    out = stash(out.distinct(), "line-matches")
    discard(*some)
    return out


def matches(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(at) of the classes that an earlier class matches, a stashed table. Classes that meet others at cold keys are tried with the
    earliest of these first, and then, if they had more and did not match, with all: most pairs are of groups whose members all match
    the first, and token sets are shuffled with each pair that is tried."""
    cold = stash(cold_meetings(sets, percent), "line-meetings")
    hot = stash(hot_keys(sets, percent).unionByName(crowd_keys(cold, percent)), "line-hot")
    least = cold.where("pos IS NULL").groupBy("b").agg(F.min("a").alias("a"), (F.max("more") | (F.min("a") < F.max("a"))).alias("more"))
    first = stash(least.select("a", "b", "more"), "line-first")
    crowd, sparse = crowd_of(hot)
    some = not crowd.isEmpty()
    discard(cold)
    named = stash(crowd.select("at").union(first.select("a")).union(first.select("b")).distinct(), "line-named")
    words = stash(token_rows(docs, named, 4 * named.count()), "line-words")
    settled = None
    if some:
        own = stash(words.join(crowd.select("at").distinct(), "at", "left_semi"), "line-crowd-words")
        old, crowd = crowd, stash(crowd.join(long_sketches(own), "at"), "line-crowd")
        settled = settled_by_leaders(crowd, own, percent)
        discard(old, own)
    left = lambda t: t if settled is None else t.join(settled.select(F.col("at").alias("b")), "b", "left_anti").select(t.columns)
    settled = both_of(settled, stash(later_of(left(first).select("a", "b"), words, percent), "line-later"))
    discard(named, words)
    again = stash(left(first.where("more")).select(F.col("b").alias("at")), "line-again")
    found = hot_pairs(sparse, settled, percent)
    if some:
        found = found.union(hot_pairs(crowd, settled, percent, long=True))
    if not again.isEmpty():
        found = found.union(cold_meetings(sets, percent, again).select("a", "b"))
    pairs = stash(found.distinct(), "line-pairs")
    discard(first, hot, crowd, again)
    if not pairs.isEmpty():
        words = stash(token_rows(docs, pairs, 4 * pairs.count()), "line-words")
        settled = both_of(settled, stash(later_of(pairs, words, percent), "line-later"))
        discard(words)
    discard(pairs)
    return settled


def removals(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_row, gone) of docs (doc_id, text, doc_row): the numbers, from 0, of the lines to remove, a row a document that has any."""
    if not 70 <= percent <= 100:
        raise ValueError("percent from 70 to 100")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("d"), "text", "doc_row")
    wide = stash(lines_of(docs, percent), "line-wide")
    sets = stash(classes(wide), "line-sets")
    lines = stash(wide.select("h1", "h2", "n", "doc_row", "line_no"), "line-places")  # the keys are in sets
    discard(wide)
    later = matches(docs, sets, percent)
    status = sets.select("h1", "h2", "n", "at", "lines").join(later.withColumn("later", F.lit(True)), "at", "left")
    status = status.where("later OR lines > 1").select("h1", "h2", "n", "at", F.coalesce("later", F.lit(False)).alias("later"))
    gone = lines.join(status, ["h1", "h2", "n"])
    gone = gone.where(F.col("later") | (place(F.col("doc_row"), F.col("line_no")) != F.col("at")))
    out = stash(gone.groupBy("doc_row").agg(F.collect_list("line_no").alias("gone")), "line-gone")  # as many as a document has lines
    discard(lines, sets, later)
    return out


def _rest(rows: DataFrame, gone: DataFrame, row: str, own: str, cut: str) -> DataFrame:
    """rows with own, the numbers of the lines to remove, cut, the lines of texts that lose some, and the remaining text in the column text."""
    # by a merge join at any size: broadcast to small inputs, the plan and what is shuffled would change as inputs grow
    joined = rows.join(gone.select(F.col("doc_row").alias(row), F.col("gone").alias(own)).hint("merge"), row, "left")
    joined = joined.withColumn(cut, F.when(F.col(own).isNotNull(), F.split("text", "\n", -1)))
    # numbers that stay, by a hashed difference: linear in the lines. The lines are a column that is used twice, so not split anew for each
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(own))
    text = F.array_join(F.transform(stay, lambda i: F.get(F.col(cut), i)), "\n")
    return joined.withColumn("text", F.when(F.col(own).isNull() | F.col("text").isNull(), F.col("text")).otherwise(text))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs, all columns, with the remaining lines as text."""
    own, row, cut = (free_name(docs, x) for x in ("_gone", "_row", "_cut"))
    rows = numbered(docs, row, "line-docs")
    gone = removals(rows.select("doc_id", "text", F.col(row).alias("doc_row")), percent)
    return _rest(rows, gone, row, own, cut).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_lines, n_removed, text)"""
    rows = numbered(docs, row := free_name(docs, "_row"), "line-docs")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(row).alias("doc_row"))
    lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    out = _rest(rows.withColumn("n_lines", lines), removals(rows, percent), "doc_row", "gone", "cut")
    return out.select("doc_id", "n_lines", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"), "text")
