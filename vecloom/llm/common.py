"""Shared parts: tables kept in the shared folder, row numbers, and word hashes of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.plans.session import shared_dir

MASK = (1 << 64) - 1
#: Fixed odd multipliers of the hashes.
BASE, STEP, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Text bytes that are hashed at once; longer texts go alone.
SLICE_BYTES = 1 << 18
#: Bytes of the batches that stashed queries hand to workers: a task holds several of them, in the JVM and in its worker.
BATCH_BYTES = 4 << 20


#: Paths of the tables that are stashed and not yet discarded.
_stashed: list[str] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later stages and retries read files, not lineage.
    Spark removes the shuffle files of the query when it has ended; batches for Python have about BATCH_BYTES."""
    spark, settings = df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in settings}
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    _stashed.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no later stage reads."""
    for t in tables:
        _delete(t.sparkSession, t._stash_path)
        _stashed.remove(t._stash_path)


def stashed() -> list[str]:
    return list(_stashed)


def sweep(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete what is stashed but for keep: for callers that have written the results that read it."""
    for path in [p for p in _stashed if p not in keep]:
        _delete(spark, path)
        _stashed.remove(path)


#: Rows that can be numbered: numbers take ROW_BITS bits.
ROW_BITS = 35


def free_name(df: DataFrame, name: str) -> str:
    """name, or name and a number, such that df has no such column."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(taken)))) if n.lower() not in taken)


def _file_rows(df: DataFrame) -> list | None:
    """(file, rows) of the Parquet files that df reads as they are; None for other frames and for files that are read twice."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return None
    meta = df.metadataColumn("_metadata")
    try:
        at = df.select(meta["file_path"].alias("file"), meta["row_index"].alias("at"))
    except AnalysisException:
        return None
    files = at.groupBy("file").agg((F.max("at") + 1).alias("top"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r.file, r.top) for r in files) if all(r.n <= r.top for r in files) else None


def numbered(df: DataFrame, name: str, stashed: str) -> DataFrame:
    """df with a number for each row, from 0, as column name: the place in its Parquet file, after the files before it, so that each
    scan gives a row the same number. What is no plain read of Parquet files is stashed first."""
    files = _file_rows(df)
    if files is None:
        df = stash(df, stashed)
        files = _file_rows(df)
    starts = [0, *np.cumsum([n for _, n in files], dtype=np.int64).tolist()]
    if starts[-1] > 1 << ROW_BITS:
        raise ValueError(f"more than 2^{ROW_BITS} rows")
    meta = df.metadataColumn("_metadata")
    file, at, start = (free_name(df, f"{name}_{x}") for x in ("file", "at", "start"))
    first = df.sparkSession.createDataFrame([(f, s) for (f, _), s in zip(files, starts, strict=False)], f"`{file}` string, `{start}` long")
    placed = df.select("*", meta["file_path"].alias(file), meta["row_index"].alias(at)).join(F.broadcast(first), file)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(start) + F.col(at)).alias(name))


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on, batches of this session's queries have about BATCH_BYTES too where they are written by others."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes of text each."""
    _, o = text_bytes(col)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(o, o[a] + limit, side="right")) - 1)
        yield a, min(b, len(col))
        a = min(b, len(col))


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places begins[i], begins[i] + 1, ..., counts[i] of them each, one after another."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - counts), counts)


class Words:
    """Byte classes of a word rule: lower-cases A-Z; bytes in separators part the words."""

    def __init__(self, separators: bytes):
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False
        self.word = self.word[lower]
        self.value = lower.astype(np.uint64) + np.uint64(1)
        self.power = self.inverse = self.total = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = 1 << max(17, (n - 1).bit_length())
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE, np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, pow(BASE, -1, 1 << 64), np.uint64)]))
            self.total = np.zeros(size + 1, np.uint64)  # used again and again: fresh memory costs more than the sums

    def hashes(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, first word of each text and the number of words)."""
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._powers(n)
        word = self.word.take(raw, mode="clip")
        turns = np.flatnonzero(word[1:] != word[:-1]) + 1  # where runs of words' bytes begin and, in turn, end
        turns = np.concatenate([np.zeros(int(word[0]), np.int64), turns, np.full(int(word[-1]), n)])
        starts, ends = turns[::2], turns[1::2] - 1
        cuts = offsets[(offsets > 0) & (offsets < n)]
        cuts = np.unique(cuts[word[cuts] & word[cuts - 1]])  # texts that meet without a separator
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts - 1]))
        total = self.total
        upto = total[1 : n + 1]
        self.value.take(raw, out=upto, mode="clip")
        np.multiply(upto, self.power[:n], out=upto)
        np.cumsum(upto, out=upto)
        h = (total[ends + 1] - total[starts]) * self.inverse[starts]
        h = mix(h ^ ((ends - starts + 1).astype(np.uint64) * np.uint64(STEP)))
        return h, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the k-word shingles, first shingle of each text and their number). A text of 1 to k - 1 words has its whole
    sequence as one shingle; a text without words has none."""
    words = np.diff(first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], np.uint64)
    full = words >= k
    if full.any():
        n = len(h) - k + 1
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s = s * np.uint64(STEP) + h[j : j + n]
        ok = np.zeros(len(h) + 1, np.int32)
        np.add.at(ok, first[:-1][full], 1)
        np.add.at(ok, first[:-1][full] + count[full], -1)
        spot = np.zeros(at[-1] + 1, np.int32)
        np.add.at(spot, at[:-1][full], 1)
        np.add.at(spot, at[:-1][full] + count[full], -1)
        out[np.cumsum(spot[:-1]) > 0] = mix(s[(np.cumsum(ok[:-1]) > 0)[:n]] ^ np.uint64(k))
    for i in np.flatnonzero((words > 0) & ~full):
        s = 0
        for x in h[first[i] : first[i + 1]]:
            s = (s * STEP + int(x)) & MASK
        out[at[i]] = mix(np.array([s], np.uint64) ^ np.uint64(int(words[i])))[0]
    return out, at


#: The word rule of near-duplicate search: everything but the six ASCII blanks.
BLANK_WORDS = Words(b" \t\n\x0b\x0c\r")
