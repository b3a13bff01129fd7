"""The binary formats, little endian:

vectors   int32 columns, int32 rows, float32 row by row
graph     int32 nodes, int32 arcs, pairs of int32 counted from 1
matrix    int32 rows, int32 columns, float64 row by row
image     int32 columns, int32 rows, float32 row by row

A file is split into ranges of whole records, each read by its own task, so that no task holds a whole file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER, HEADER_BYTES = "<ii", 8


def _open(path: str):
    import pyarrow.fs as fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def header(path: str) -> tuple[int, int]:
    with _open(path) as f:  # a missing file raises
        return struct.unpack(HEADER, f.read(HEADER_BYTES))


def _ranges(spark: SparkSession, path: str, records: int, width: int, schema: str, parse: Callable, block_mb: int = 32) -> DataFrame:
    step = max(1, (block_mb << 20) // max(1, width))
    starts = spark.range(0, max(records, 0), step, max(1, -(-records // step))).withColumnRenamed("id", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                n = min(step, records - start)
                with _open(path) as f:
                    raw = f.read_at(n * width, HEADER_BYTES + start * width)
                if len(raw) != n * width:
                    raise ValueError(f"{path} ends early")
                yield parse(raw, start, n)

    return starts.mapInArrow(read, schema)


def read_vectors(spark: SparkSession, path: str, id_col: str = "vec_id") -> DataFrame:
    dim, rows = header(path)

    def parse(raw: bytes, start: int, n: int) -> pa.RecordBatch:
        values = pa.array(np.frombuffer(raw, "<f4"))
        lists = pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype=np.int32), values)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), lists], [id_col, "embedding"])

    return _ranges(spark, path, rows, 4 * dim, f"{id_col} long, embedding array<float>", parse)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), ids from 0."""
    n_nodes, arcs = header(path)

    def parse(raw: bytes, start: int, n: int) -> pa.RecordBatch:
        pairs = np.frombuffer(raw, "<i4").reshape(-1, 2).astype(np.int64) - 1
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["src", "dst"])

    return spark.range(n_nodes), _ranges(spark, path, arcs, 8, "src long, dst long", parse)


def _cells(path: str, kind: str, swap: bool, spark: SparkSession, schema: str, names: list[str], index) -> DataFrame:
    rows, cols = header(path)[::-1] if swap else header(path)
    size = np.dtype(kind).itemsize

    def parse(raw: bytes, start: int, n: int) -> pa.RecordBatch:
        values = np.frombuffer(raw, kind)
        i, j = np.repeat(np.arange(start, start + n), cols).astype(index), np.tile(np.arange(cols), n).astype(index)
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(values)], names)

    return _ranges(spark, path, rows, size * cols, schema, parse)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v), counted from 0."""
    return _cells(path, "<f8", False, spark, "i long, j long, v double", ["i", "j", "v"], np.int64)


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """(y, x, v), counted from 0."""
    return _cells(path, "<f4", True, spark, "y int, x int, v float", ["y", "x", "v"], np.int32)


def _create(path: str):
    import pyarrow.fs as fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_output_stream(inner)


def _save(path: str, head: tuple[int, int], rows: Iterator, pack: Callable[[list], bytes], at_once: int = 4096) -> None:
    """The rows, which come one after another, behind a header. A format of one file is written by one process: the driver, which holds
    a partition and at_once rows."""
    with _create(path) as f:
        f.write(struct.pack(HEADER, *head))
        part = []
        for row in rows:
            part.append(row)
            if len(part) == at_once:
                f.write(pack(part))
                part = []
        if part:
            f.write(pack(part))


def save_vectors(df: DataFrame, path: str, id_col: str = "vec_id") -> None:
    """The vectors (id, embedding) of df in order of id; the format has no ids."""
    rows, dim = df.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()

    def pack(part: list) -> bytes:
        if any(r[0] is None or len(r[0]) != dim for r in part):
            raise ValueError("vectors are null or of several lengths")
        return np.array([r[0] for r in part], "<f4").tobytes()

    _save(path, (dim or 0, rows), df.orderBy(id_col).select("embedding").toLocalIterator(), pack)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The arcs (src, dst), ids from 0 to the number of nodes less 1, in order."""
    pack = lambda part: (np.array(part, np.int64) + 1).astype("<i4").tobytes()
    _save(path, (nodes.count(), edges.count()), edges.select("src", "dst").orderBy("src", "dst").toLocalIterator(), pack)


def save_matrix(df: DataFrame, path: str) -> None:
    """The matrix (i, j, v), ids from 0; cells that df lacks are 0. A row of the matrix is held at a time."""
    rows, cols = (x or 0 for x in df.agg(F.max("i") + 1, F.max("j") + 1).first())
    cells = df.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("row"))  # as many as the matrix has columns
    every = df.sparkSession.range(rows).withColumnRenamed("id", "i").join(cells, "i", "left").orderBy("i").select("row")

    def pack(part: list) -> bytes:
        x = np.zeros((len(part), cols))
        for k, r in enumerate(part):
            for j, v in r[0] or ():
                x[k, j] = v
        return x.astype("<f8").tobytes()

    _save(path, (rows, cols), every.toLocalIterator(), pack, 64)


def write_vectors(path: str, x: np.ndarray) -> None:
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, x.shape[1], x.shape[0]) + np.ascontiguousarray(x, "<f4").tobytes())


def write_graph(path: str, n_nodes: int, arcs: np.ndarray) -> None:
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, n_nodes, len(arcs)) + (np.asarray(arcs) + 1).astype("<i4").tobytes())


def write_matrix(path: str, x: np.ndarray) -> None:
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, *x.shape) + np.ascontiguousarray(x, "<f8").tobytes())


def write_gray_image(path: str, rgb: np.ndarray) -> None:
    """An RGB array (rows, columns, 3) as the mean of its channels."""
    gray = rgb.astype(np.float64).mean(axis=2)
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, gray.shape[1], gray.shape[0]) + gray.astype("<f4").tobytes())
