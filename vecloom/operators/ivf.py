"""Inverted lists: coarse cells, residual codes, search of the w nearest cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import kernels
from vecloom.operators.exact import KNN_SCHEMA, collect_queries, union_blocks
from vecloom.operators.kmeans import Model, assign, kmeans, lloyd
from vecloom.operators.pq import code_matrix
from vecloom.operators.topk import FEW, first_rows, top_k

#: Rows of the learning set, if not given: all rows over this.
LEARN_SHARE = 20


@dataclass
class IvfModel:
    coarse: Model
    fine: Model


def residuals(df: DataFrame, coarse: Model) -> DataFrame:
    """Rows with a cell: the embedding minus the cell's centroid; other columns stay."""
    book = coarse.centroids[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("embedding")
            x = kernels.matrix(b.column(at), book.shape[1])
            rest = x - book[b.column(b.schema.get_field_index("cell")).to_numpy(zero_copy_only=False)]
            lists = pa.ListArray.from_arrays(np.arange(0, rest.size + 1, book.shape[1], dtype=np.int32), rest.ravel())
            yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(scan, fields)


def ivf_train(df: DataFrame, kc: int = 8192, m: int = 8, k: int = 256, nr: int | None = None, **options) -> IvfModel:
    """Coarse and residual codebooks from the nr rows of least vec_id (a twentieth of the rows if not given)."""
    rows = df.select("vec_id", "embedding")
    nr = rows.count() // LEARN_SHARE if nr is None else nr
    if kc > nr or k > nr:
        raise ValueError(f"{nr} learning rows for {kc} cells and {k} codes")
    if nr <= FEW:  # one process holds them
        some = first_rows(rows, nr).orderBy("vec_id").select("embedding").toArrow().combine_chunks()
        x = kernels.matrix(pa.concat_arrays(some["embedding"].chunks))
        if max(kc, k) > len(x):
            raise ValueError(f"{len(x)} learning rows for {kc} cells and {k} codes")
        coarse = lloyd(x, x[:kc], **options)
        rest = x - coarse.centroids[0][kernels.nearest(x, coarse.centroids[0])[0]]
        return IvfModel(coarse, lloyd(rest, rest[:k], m, **options))
    learn = first_rows(rows, nr).persist()
    try:
        coarse = kmeans(learn, kc, **options)
        rest = residuals(assign(learn, coarse, "cell"), coarse)
        return IvfModel(coarse, kmeans(rest.select("vec_id", "embedding"), k, groups=m, **options))
    finally:
        learn.unpersist()


def ivf_encode(df: DataFrame, model: IvfModel) -> DataFrame:
    """(vec_id, cell, codes); every row is encoded by its residual."""
    cells = assign(df.select("vec_id", "embedding"), model.coarse, "cell")
    return assign(residuals(cells, model.coarse), model.fine).select("vec_id", "cell", "codes")


def write_index(codes: DataFrame, path: str) -> None:
    """Stored by cell, so that a search reads only the probed cells."""
    codes.repartition("cell", F.pmod("vec_id", F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)


def inverted_lists(codes: DataFrame, kc: int) -> DataFrame:
    """(cell, cnt, start) for all kc cells: sizes and exclusive prefix sums. The window runs over kc counts."""
    cells = codes.sparkSession.range(kc).select(F.col("id").cast("int").alias("cell"))
    counts = cells.join(codes.groupBy("cell").agg(F.count(F.lit(1)).alias("cnt")), "cell", "left").fillna(0, ["cnt"])
    w = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("cnt").over(w), F.lit(0)))


def probes(q: np.ndarray, coarse: Model, w: int) -> np.ndarray:
    """(queries, min(w, kc)) nearest cells, ties by cell."""
    d = kernels.distances(q, coarse.centroids[0])
    return np.argsort(d, axis=1, kind="stable")[:, :w]


class Probed:
    """The queries of each cell, and the distances of a cell's rows to them. A table for each query and cell would be queries x w x groups x
    k numbers. With the query's own tables of scalar products instead, |q - c - f|^2 = |q - c|^2 + (|f|^2 + 2 c f) - 2 q f: the
    second term is a row's, whatever the query."""

    def __init__(self, q: np.ndarray, model: IvfModel, w: int, metric: str):
        self.q, self.model, self.symmetric = q, model, metric == "sdc"
        self.book, self.fine = model.coarse.centroids[0], model.fine.centroids
        self.groups, self.width = self.fine.shape[0], self.fine.shape[2]
        cells = probes(q, model.coarse, min(w, model.coarse.k)).ravel()
        order = np.argsort(cells, kind="stable")
        self.owners = np.repeat(np.arange(len(q)), len(cells) // max(1, len(q)))[order]
        self.bounds = np.searchsorted(cells[order], np.arange(model.coarse.k + 1))
        if self.symmetric:
            self.table = np.stack([kernels.distances(c, c) for c in self.fine])
        else:
            self.squares = np.einsum("gkd,gkd->gk", self.fine, self.fine)
            self.products = np.stack([self._part(q, g) @ self.fine[g].T for g in range(self.groups)], axis=1)

    def _part(self, x: np.ndarray, g: int) -> np.ndarray:
        return x[:, g * self.width : (g + 1) * self.width]

    def rows(self, cell: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the queries that probe the cell, their distances to the rows)"""
        at = self.owners[self.bounds[cell] : self.bounds[cell + 1]]
        if not len(at):
            return at, np.zeros((0, len(codes)))
        rest = self.q[at] - self.book[cell]
        out = np.zeros((len(at), len(codes)))
        if self.symmetric:
            for g in range(self.groups):
                own = kernels.nearest(self._part(rest, g), self.fine[g])[0]
                out += self.table[g][own][:, codes[:, g]]
            return at, out
        of_row = np.zeros(len(codes))
        for g in range(self.groups):
            of_row += (self.squares[g] + 2 * (self.fine[g] @ self.book[cell][g * self.width : (g + 1) * self.width]))[codes[:, g]]
            out -= 2 * self.products[at, g][:, codes[:, g]]
        return at, np.maximum(out + of_row + np.einsum("ij,ij->i", rest, rest)[:, None], 0.0)


def ivf_search(codes: DataFrame, queries: DataFrame, model: IvfModel, k: int, w: int = 16, metric: str = "adc") -> DataFrame:
    """(qid, rk, vec_id, dist). Only the probed cells are read; on a table stored by cell that prunes files. Tasks get the queries and
    make their tables; QUERY_BYTES bounds both."""
    if metric not in ("adc", "sdc"):
        raise ValueError(metric)
    parts, every = [], codes.sparkSession.createDataFrame([], KNN_SCHEMA)
    for qids, q in collect_queries(queries, 8 * model.fine.groups * model.fine.k):
        if q.shape[1] != model.coarse.dim:
            raise ValueError(f"queries have dimension {q.shape[1]}, the cells {model.coarse.dim}")
        wanted = np.unique(probes(q, model.coarse, min(w, model.coarse.k)))

        def scan(batches: Iterator[pa.RecordBatch], qids=qids, q=q) -> Iterator[pa.RecordBatch]:
            probed, best = Probed(q, model, w, metric), kernels.TopK(qids, k)
            for b in batches:
                ids, cell = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                own = code_matrix(b.column(2), model.fine.groups)
                order = np.argsort(cell, kind="stable")
                found = []
                for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    if not len(rows):
                        continue
                    per_cell = max(1, int(np.diff(probed.bounds)[cell[rows[0]]]))
                    for s in kernels.row_blocks(len(rows), per_cell):
                        at, dist = probed.rows(int(cell[rows[0]]), own[rows[s]])
                        if dist.size:
                            found.append(best.candidates(at, ids[rows[s]], dist))
                    if sum(len(f[0]) for f in found) > kernels.CELLS:
                        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
                        found = []
                if found:
                    best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield best.batch()

        probed = codes.select("vec_id", "cell", "codes")
        if len(wanted) < model.coarse.k:
            probed = probed.where(F.col("cell").isin(wanted.tolist()))
        parts.append(probed.mapInArrow(scan, KNN_SCHEMA))
    return top_k(union_blocks(parts, every), k)
