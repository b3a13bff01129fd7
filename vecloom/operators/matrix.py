"""Matrices in coordinate form (i, j, v), vectors as (j, x) or (id, x)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matvec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, y)"""
    return matrix.join(vector, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a x b, for sparse matrices: an equi-join on k and a sum."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("bv"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("av") * F.col("bv")).alias("v"))


def blocks(matrix: DataFrame, size: int) -> DataFrame:
    """(bi, bj, block): tiles of size x size as binary float64; at most size^2 cells meet in a group."""
    tiles = matrix.select(
        F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"), F.pmod("i", F.lit(size)).alias("r"), F.pmod("j", F.lit(size)).alias("c"), "v"
    )

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        x = np.zeros((size, size))
        np.add.at(x, (t["r"].to_numpy(), t["c"].to_numpy()), t["v"].to_numpy())
        return pa.table({"bi": [key[0].as_py()], "bj": [key[1].as_py()], "block": [x.tobytes()]})

    return tiles.groupBy("bi", "bj").applyInArrow(tile, "bi long, bj long, block binary")


def gemm_blocked(a: DataFrame, b: DataFrame, size: int = 256) -> DataFrame:
    """As gemm without the cells of value 0, for dense matrices: tiles join on the inner block and multiply in NumPy, so a cell is shuffled
    once for each block it meets instead of once for each product."""
    left = blocks(a, size).select("bi", F.col("bj").alias("bk"), F.col("block").alias("x"))
    right = blocks(b, size).select(F.col("bi").alias("bk"), "bj", F.col("block").alias("y"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for bi, bj, x, y in zip(*(t.column(n).to_pylist() for n in ("bi", "bj", "x", "y")), strict=True):
                z = np.frombuffer(x).reshape(size, size) @ np.frombuffer(y).reshape(size, size)
                r, c = np.nonzero(z)
                yield pa.RecordBatch.from_pydict({"i": bi * size + r, "j": bj * size + c, "v": z[r, c]})

    sums = left.join(right, "bk").mapInArrow(multiply, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return sums.where("v <> 0")


def vector_stats(v: DataFrame, col: str = "x") -> DataFrame:
    """One row: sum, L1 norm, sum of squares."""
    x = F.col(col)
    return v.agg(F.sum(x).alias("total"), F.sum(F.abs(x)).alias("l1"), F.sum(x * x).alias("squares"))


def l1_diff(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: the L1 distance of two vectors (id, x)."""
    other = b.select(id_col, F.col("x").alias("y"))
    return a.join(other, id_col).agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("l1_diff"))


def l1_normalize(v: DataFrame, id_col: str = "id") -> DataFrame:
    total = v.agg(F.sum(F.abs("x"))).first()[0]
    return v.select(id_col, (F.col("x") / F.lit(total)).alias("x"))


def leibniz_pi(spark, terms: int) -> DataFrame:
    from vecloom.functions.vectors import leibniz_term

    return spark.range(terms).agg(F.sum(leibniz_term(F.col("id"))).alias("pi"))
