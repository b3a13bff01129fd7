"""NumPy kernels for Arrow batches. Higher-order SQL functions are interpreted per element; these are not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of a distance matrix that exist at once.
CELLS = 1 << 21
#: Relative error that is granted to a distance made of scalar products; what is so near is computed as a sum of squares.
SLACK = 1e-11


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """An Arrow list column as a float64 matrix. Null, NaN and vectors of other lengths raise ValueError."""
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count or flat.null_count or np.isnan(x).any():
        raise ValueError("vectors are null or hold null or NaN")
    size = np.diff(column.offsets.to_numpy())
    if dim is None:
        dim = int(size[0]) if len(size) else 0
    if (size != dim).any():
        raise ValueError(f"vector lengths {size.min()} to {size.max()}, expected {dim}")
    return x.reshape(len(column), dim)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows of x by rows of c) as sums of squared differences."""
    out = np.empty((len(x), len(c)))
    if len(x) < len(c):
        for i in range(len(x)):
            diff = c - x[i]
            out[i] = np.einsum("ij,ij->i", diff, diff)
        return out
    for i in range(len(c)):
        diff = x - c[i]
        out[:, i] = np.einsum("ij,ij->i", diff, diff)
    return out


def _products(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """(distances up to a small error, less the squares of x; a bound of the error)."""
    cc = np.einsum("ij,ij->i", c, c)
    most = (np.einsum("ij,ij->i", x, x).max(initial=0.0) + cc.max(initial=0.0)) * SLACK
    return cc - 2 * (x @ c.T), most


def row_blocks(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, columns))
    for a in range(0, rows, step):
        yield slice(a, min(rows, a + step))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, distance) of each row; the lowest index wins ties. Scalar products find the candidates, sums of squares decide."""
    best, label = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int32)
    for s in row_blocks(len(x), len(c)):
        part = x[s]
        d, slack = _products(part, c)
        row, at = np.nonzero(d <= d.min(axis=1, keepdims=True) + slack)
        diff = part[row] - c[at]
        exact = np.einsum("ij,ij->i", diff, diff)
        order = np.lexsort((at, exact, row))
        first = order[np.searchsorted(row[order], np.arange(len(part)))]
        best[s], label[s] = exact[first], at[first]
    return label, best


class TopK:
    """Best k rows of each query over the batches of one partition; memory is queries x k. Queries are named by their place."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = np.asarray(qids, np.int64), k
        self.at = np.empty(0, np.int64)
        self.ids, self.dist = np.empty(0, np.int64), np.empty(0)
        self.bound = np.full(len(self.qids), np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Candidates: place of the query, id and distance."""
        some = dist <= self.bound[at]
        if not some.any():
            return
        at, ids, dist = (np.concatenate([old, new[some]]) for old, new in ((self.at, at), (self.ids, ids), (self.dist, dist)))
        order = np.lexsort((ids, dist, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        self.at, self.ids, self.dist = at[keep], ids[order][keep], dist[order][keep]
        last = rank[keep] == self.k - 1
        self.bound[self.at[last]] = self.dist[last]

    def add_rows(self, ids: np.ndarray, x: np.ndarray, q: np.ndarray) -> None:
        """All rows of x for all queries: scalar products find the candidates, sums of squares decide."""
        for s in row_blocks(len(x), len(q)):
            part = x[s]
            d, slack = _products(q, part)  # a row a query
            squares = np.einsum("ij,ij->i", q, q)
            limit = self.bound - squares + slack
            if len(part) > self.k:
                limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + slack)
            at, row = np.nonzero(d <= limit[:, None])
            diff = part[row] - q[at]
            self.add(at, ids[s][row], np.einsum("ij,ij->i", diff, diff))

    def candidates(self, at: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What add takes, of a matrix with a row a query of at and a column an id."""
        limit = self.bound[at]
        if dist.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
        row, col = np.nonzero(dist <= limit[:, None])
        return at[row], ids[col], dist[row, col]

    def add_matrix(self, at: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        self.add(*self.candidates(at, ids, dist))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"qid": self.qids[self.at], "vec_id": self.ids, "dist": self.dist})
