"""Lloyd's k-means, for all groups of a product quantizer in one scan an iteration.

Each task adds up its rows by (group, code) and emits at most groups x k rows, so an iteration shuffles sums, not vectors.
The driver holds the centroids (k x dimension numbers), and learning sets of at most LOCAL_BYTES, which need no job an iteration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import kernels
from vecloom.operators.topk import first_rows

SUMS_SCHEMA = "grp int, code int, n long, total array<double>, cost double"


@dataclass
class Model:
    """centroids: (groups, k, width). cost: the last objective of each group. rounds: iterations made."""

    centroids: np.ndarray
    cost: np.ndarray
    rounds: np.ndarray
    history: list

    @property
    def groups(self) -> int:
        return self.centroids.shape[0]

    @property
    def k(self) -> int:
        return self.centroids.shape[1]

    @property
    def dim(self) -> int:
        return self.centroids.shape[0] * self.centroids.shape[2]

    def frame(self, spark) -> DataFrame:
        rows = [(g, c, self.centroids[g, c].tolist()) for g in range(self.groups) for c in range(self.k)]
        return spark.createDataFrame(rows, "grp int, code int, centroid array<double>")


#: Bytes of vectors that are trained on in one process; more are scanned by Spark once an iteration.
LOCAL_BYTES = 1 << 25


def sums_of(batches: Iterator[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, cost) by (group, code) of the rows of some matrices."""
    m, k, width = centroids.shape
    sums, n, cost = np.zeros((m, k, width)), np.zeros((m, k), np.int64), np.zeros((m, k))
    for x in batches:
        for g in range(m):
            part = x[:, g * width : (g + 1) * width]
            label, d = kernels.nearest(part, centroids[g])
            n[g] += np.bincount(label, minlength=k)
            cost[g] += np.bincount(label, weights=d, minlength=k)
            for i in range(width):
                sums[g, :, i] += np.bincount(label, weights=part[:, i], minlength=k)
    return sums, n, cost


def step(df: DataFrame | np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, cost by group) of the rows under the given centroids."""
    m, k, width = centroids.shape
    if isinstance(df, np.ndarray):
        sums, n, cost = sums_of(iter([df]), centroids)
        return sums, n, cost.sum(axis=1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, cost = sums_of((kernels.matrix(b.column(0), m * width) for b in batches), centroids)
        g, c = np.nonzero(n)
        yield pa.RecordBatch.from_pydict(
            {"grp": g.astype(np.int32), "code": c.astype(np.int32), "n": n[g, c], "total": list(sums[g, c]), "cost": cost[g, c]},
            schema=pa.schema([("grp", pa.int32()), ("code", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64())), ("cost", pa.float64())]),
        )

    part = df.select("embedding").mapInArrow(scan, SUMS_SCHEMA)
    total = F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")
    rows = part.groupBy("grp", "code").agg(F.sum("n").alias("n"), total, F.sum("cost").alias("cost")).collect()
    sums, n, cost = np.zeros((m, k, width)), np.zeros((m, k), np.int64), np.zeros(m)
    for r in sorted(rows, key=lambda r: (r["grp"], r["code"])):
        sums[r["grp"], r["code"]], n[r["grp"], r["code"]] = r["total"], r["n"]
        cost[r["grp"]] += r["cost"]
    return sums, n, cost


def held(df: DataFrame, dim: int) -> DataFrame | np.ndarray:
    """The vectors as a matrix, if they have at most LOCAL_BYTES."""
    most = max(1, LOCAL_BYTES // (8 * dim))
    some = df.select("embedding").limit(most + 1).toArrow()
    if len(some) > most:
        return df.select("embedding")
    return kernels.matrix(some.column(0).combine_chunks(), dim) if len(some) else np.zeros((0, dim))


def update(centroids: np.ndarray, sums: np.ndarray, n: np.ndarray, empty: str) -> np.ndarray:
    """Means; a centroid without members becomes zero, or stays with empty='keep'."""
    means = sums / np.maximum(n, 1)[:, :, None]
    return np.where((n == 0)[:, :, None], centroids, means) if empty == "keep" else means


def kmeans(df: DataFrame, k: int, groups: int = 1, eps: float = 0.01, tmin: int = 10, tmax: int = 100, init: np.ndarray | None = None, empty: str = "zero") -> Model:
    """Train on (vec_id, embedding). Starts from the k rows of least vec_id. Each group stops by itself: it goes on while
    t < tmin, or t < tmax and the relative change of its objective is over eps. Many rows are read again each iteration: persist what is
    dear to make."""
    if init is None:
        start = first_rows(df.select("vec_id", "embedding"), k).collect()
        if len(start) < k:
            raise ValueError(f"{len(start)} rows for {k} centroids")
        init = np.array([r["embedding"] for r in sorted(start, key=lambda r: r["vec_id"])], dtype=np.float64)
    return lloyd(held(df, init.shape[1]), init, groups, eps, tmin, tmax, empty)


def lloyd(rows: DataFrame | np.ndarray, init: np.ndarray, groups: int = 1, eps: float = 0.01, tmin: int = 10, tmax: int = 100, empty: str = "zero") -> Model:
    """The iterations of kmeans, from the centroids init (k, dimension), on a table (embedding) or a matrix."""
    k, dim = init.shape
    if dim % groups:
        raise ValueError(f"dimension {dim} is not divisible by {groups} groups")
    c = np.ascontiguousarray(init.reshape(k, groups, dim // groups).transpose(1, 0, 2))
    sums, n, cost = step(rows, c)
    live, rounds, history = np.ones(groups, bool), np.zeros(groups, int), [cost.copy()]
    previous, t = np.full(groups, np.inf), 0
    while True:
        change = np.where(previous == 0, 0.0, np.abs(previous - cost) / np.where(previous == 0, 1, np.where(np.isinf(previous), 1, previous)))
        change = np.where(np.isinf(previous), np.inf, change)
        live &= (t < tmin) | ((t < tmax) & (change > eps))
        if not live.any():
            return Model(c, cost, rounds, history)
        c = np.where(live[:, None, None], update(c, sums, n, empty), c)
        previous, t = np.where(live, cost if t else np.inf, previous), t + 1
        rounds[live] = t
        sums, n, cost = step(rows, c)
        history.append(cost.copy())


def assign(df: DataFrame, model: Model, out: str = "codes") -> DataFrame:
    """Adds the codes (array<int>) of each row, or with one group an int label; other columns stay."""
    c, m, dim = model.centroids, model.groups, model.dim
    single = m == 1
    width = dim // m

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = kernels.matrix(b.column(b.schema.get_field_index("embedding")), dim)
            codes = np.stack([kernels.nearest(x[:, g * width : (g + 1) * width], c[g])[0] for g in range(m)], axis=1)
            if single:
                col = pa.array(codes[:, 0])
            else:
                col = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, m, dtype=np.int32), codes.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, col], [*b.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return df.drop(out).mapInArrow(scan, f"{fields}, {out} {'int' if single else 'array<int>'}")


def wcss(df: DataFrame, model: Model) -> np.ndarray:
    """Objective by group: the sum of squared distances to the own centroid."""
    return step(df, model.centroids)[2]
