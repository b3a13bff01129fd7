"""Exact k-nearest neighbours of a query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.functions import kernels
from vecloom.operators.topk import top_k

KNN_SCHEMA = "qid long, vec_id long, dist double"
#: Bytes of queries (and of what a search derives from them) that each task holds at once; larger query sets take several passes.
QUERY_BYTES = 1 << 26


#: Query sets of up to so many rows are fetched at once, larger ones a partition at a time.
AT_ONCE = 8192


def collect_queries(queries: DataFrame, row_bytes: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (ids, matrix), so that neither the driver nor a task holds more than QUERY_BYTES; row_bytes is for one query, its
    vector if not given."""
    rows = queries.select("qid", "embedding")
    some = rows.limit(AT_ONCE + 1).toArrow().combine_chunks()
    if len(some) <= AT_ONCE:
        if not len(some):
            return
        q = kernels.matrix(pa.concat_arrays(some["embedding"].chunks))
        if some["qid"].null_count:
            raise ValueError("queries have null ids")
        ids, block = some["qid"].to_numpy().astype(np.int64), max(1, QUERY_BYTES // (row_bytes or 8 * max(1, q.shape[1])))
        for at in range(0, len(ids), block):
            yield ids[at : at + block], q[at : at + block]
        return
    ids, held = [], []
    for r in rows.toLocalIterator():
        if r[1] is None or (held and len(r[1]) != len(held[0])):
            raise ValueError("queries are null or of several lengths")
        ids.append(r[0])
        held.append(r[1])
        if len(ids) == max(1, QUERY_BYTES // (row_bytes or 8 * max(1, len(r[1])))):
            yield _block(ids, held)
            ids, held = [], []
    if ids:
        yield _block(ids, held)


def _block(ids: list, rows: list) -> tuple[np.ndarray, np.ndarray]:
    q = np.array(rows, dtype=np.float64)
    if None in ids or np.isnan(q).any():
        raise ValueError("queries have null ids, null or NaN")
    return np.array(ids, np.int64), q


def union_blocks(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rk, vec_id, dist). One scan a block of queries; each task keeps k rows a query, so little is shuffled."""
    parts = []
    for qids, q in collect_queries(queries):

        def scan(batches: Iterator[pa.RecordBatch], qids=qids, q=q) -> Iterator[pa.RecordBatch]:
            best = kernels.TopK(qids, k)
            for b in batches:
                best.add_rows(b.column(0).to_numpy(zero_copy_only=False), kernels.matrix(b.column(1), q.shape[1]), q)
            yield best.batch()

        parts.append(vectors.select("vec_id", "embedding").mapInArrow(scan, KNN_SCHEMA))
    return top_k(union_blocks(parts, vectors.sparkSession.createDataFrame([], KNN_SCHEMA)), k)


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: hits, total, recall."""
    from pyspark.sql import functions as F

    hit = found.select("qid", "vec_id").withColumn("hit", F.lit(1))
    j = truth.select("qid", "vec_id").join(hit, ["qid", "vec_id"], "left")
    return j.agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("total")).withColumn(
        "recall", F.round(F.col("hits") / F.col("total"), 6)
    )
