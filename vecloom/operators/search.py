"""One front for the four ways of searching, by parameters instead of flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from vecloom.operators import ivf, pq
from vecloom.sources.tables import checked


@dataclass
class Params:
    exhaustive: bool = True
    metric: str = "sdc"
    knn: int = 1
    m: int = 8
    k: int = 256
    kc: int = 8192
    w: int = 16
    eps: float = 0.01
    tmin: int = 10
    tmax: int = 100
    nr: int | None = None
    empty: str = "zero"

    def training(self) -> dict:
        return {"eps": self.eps, "tmin": self.tmin, "tmax": self.tmax, "empty": self.empty}


@dataclass
class Index:
    params: Params
    model: object
    codes: DataFrame = field(repr=False)
    dim: int = 0


def build_index(vectors: DataFrame, params: Params) -> Index:
    rows, dim = checked(vectors)
    if dim % params.m:
        raise ValueError(f"dimension {dim} is not divisible by m = {params.m}")
    if params.exhaustive:
        model = pq.pq_train(rows, params.m, params.k, **params.training())
        return Index(params, model, pq.pq_encode(rows, model), dim)
    model = ivf.ivf_train(rows, params.kc, params.m, params.k, params.nr, **params.training())
    return Index(params, model, ivf.ivf_encode(rows, model), dim)


def search(index: Index, queries: DataFrame) -> DataFrame:
    p = index.params
    queries, _ = checked(queries, index.dim, "qid")
    if p.exhaustive:
        return pq.pq_search(index.codes, queries, index.model, p.knn, p.metric)
    return ivf.ivf_search(index.codes, queries, index.model, p.knn, p.w, p.metric)
