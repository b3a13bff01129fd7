"""Product quantization: training, codes, distance tables, exhaustive search with symmetric or asymmetric distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import kernels
from vecloom.functions.vectors import sq_l2
from vecloom.operators.exact import KNN_SCHEMA, collect_queries, union_blocks
from vecloom.operators.kmeans import Model, assign, kmeans
from vecloom.operators.topk import top_k


def pq_train(df: DataFrame, m: int = 8, k: int = 256, **options) -> Model:
    return kmeans(df, k, groups=m, **options)


def pq_encode(df: DataFrame, model: Model) -> DataFrame:
    """(vec_id, codes)"""
    return assign(df.select("vec_id", "embedding"), model).drop("embedding")


def sdc_table(codebook: DataFrame) -> DataFrame:
    """(grp, c1, c2, dist) for c1 > c2, from a codebook (grp, code, centroid) of fixed size."""
    a = codebook.select("grp", F.col("code").alias("c1"), F.col("centroid").alias("x"))
    b = codebook.select("grp", F.col("code").alias("c2"), F.col("centroid").alias("y"))
    pairs = a.join(b, (a.grp == b.grp) & (a.c1 > b.c2)).drop(b.grp)
    return pairs.select("grp", "c1", "c2", sq_l2(F.col("x"), F.col("y")).alias("dist"))


def sdc_matrix(model: Model) -> np.ndarray:
    """(groups, k, k), symmetric, zero on the diagonal."""
    return np.stack([kernels.distances(c, c) for c in model.centroids])


def adc_luts(q: np.ndarray, model: Model) -> np.ndarray:
    """(queries, groups, k): distances of each query's parts to the sub-centroids."""
    m, k, width = model.centroids.shape
    return np.stack([kernels.distances(q[:, g * width : (g + 1) * width], model.centroids[g]) for g in range(m)], axis=1)


def sdc_luts(q: np.ndarray, model: Model) -> np.ndarray:
    """As adc_luts, but from the query's own codes."""
    m, _, width = model.centroids.shape
    table = sdc_matrix(model)
    codes = [kernels.nearest(q[:, g * width : (g + 1) * width], model.centroids[g])[0] for g in range(m)]
    return np.stack([table[g][codes[g]] for g in range(m)], axis=1)


def adc_table(queries: DataFrame, model: Model) -> DataFrame:
    """(qid, grp, code, dist)"""
    book = F.broadcast(model.frame(queries.sparkSession))  # groups x k centroids
    width = model.centroids.shape[2]
    parts = queries.select("qid", F.posexplode(F.array(*[F.slice("embedding", g * width + 1, width) for g in range(model.groups)])).alias("grp", "part"))
    return parts.join(book, "grp").select("qid", "grp", "code", sq_l2(F.col("part"), F.col("centroid")).alias("dist"))


def table_sums(luts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, rows): distance of each row of codes under each (groups, k) table."""
    out = np.zeros((len(luts), len(codes)))
    for g in range(codes.shape[1]):
        out += luts[:, g][:, codes[:, g]]
    return out


def code_matrix(column: pa.Array, m: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)


def pq_search(codes: DataFrame, queries: DataFrame, model: Model, k: int, metric: str = "adc") -> DataFrame:
    """(qid, rk, vec_id, dist) over all codes; metric 'adc' or 'sdc'."""
    if metric not in ("adc", "sdc"):
        raise ValueError(metric)
    parts = []
    for qids, q in collect_queries(queries, 8 * model.groups * model.k):
        if q.shape[1] != model.dim:
            raise ValueError(f"queries have dimension {q.shape[1]}, the codebook {model.dim}")

        def scan(batches: Iterator[pa.RecordBatch], qids=qids, q=q) -> Iterator[pa.RecordBatch]:
            luts = (adc_luts if metric == "adc" else sdc_luts)(q, model)
            best, at = kernels.TopK(qids, k), np.arange(len(qids))
            for b in batches:
                ids, own = b.column(0).to_numpy(zero_copy_only=False), code_matrix(b.column(1), model.groups)
                for s in kernels.row_blocks(len(ids), len(qids)):
                    best.add_matrix(at, ids[s], table_sums(luts, own[s]))
            yield best.batch()

        parts.append(codes.select("vec_id", "codes").mapInArrow(scan, KNN_SCHEMA))
    return top_k(union_blocks(parts, codes.sparkSession.createDataFrame([], KNN_SCHEMA)), k)


def reconstruct(codes: DataFrame, model: Model) -> DataFrame:
    """(vec_id, embedding): the sub-centroids of the codes, one after another."""
    book = model.centroids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = code_matrix(b.column(1), book.shape[0])
            rows = np.concatenate([book[g][own[:, g]] for g in range(book.shape[0])], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["vec_id", "embedding"])

    return codes.select("vec_id", "codes").mapInArrow(scan, "vec_id long, embedding array<double>")
