"""Top-k by (distance, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, key: str = "qid", id_col: str = "vec_id") -> DataFrame:
    """(key, rk, id, dist), ranks from 1; fewer rows where there are fewer candidates. Spark keeps k rows a key before the shuffle."""
    w = Window.partitionBy(key).orderBy("dist", id_col)
    return df.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select(key, F.col("rk").cast("int").alias("rk"), id_col, "dist")


def nearest_one(df: DataFrame, key: str = "qid", id_col: str = "vec_id") -> DataFrame:
    """The 1-NN as an aggregate."""
    best = F.min(F.struct("dist", id_col)).alias("b")
    return df.groupBy(key).agg(best).select(key, F.col(f"b.{id_col}").alias(id_col), F.col("b.dist").alias("dist"))


def in_order(df: DataFrame, *cols: str) -> DataFrame:
    """A full sort, for the callers that want every candidate in order."""
    return df.orderBy(*cols)


#: So many rows are taken by a sort with a limit, which one task merges; more by a bound of the id.
FEW, CUTS = 10_000, 4096


def first_rows(df: DataFrame, n: int, id_col: str = "vec_id") -> DataFrame:
    """The n rows of least id; ids are unique. Of many rows, the n-th id is found by counts of CUTS ranges, narrower each time, and the rows
    stay where they are."""
    if n <= FEW:
        return df.orderBy(id_col).limit(n)
    ids, left = df.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL"), n
    low, high, total = ids.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if total <= n:
        return df
    while True:
        width = (high - low) // CUTS + 1
        inside = ids.where(F.col("id").between(low, high))
        counts = sorted(tuple(r) for r in inside.groupBy(F.expr(f"(id - ({low}L)) DIV {width}L").alias("b")).count().collect())
        for b, m in counts:
            if left <= m:
                break
            left -= m
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
        if width == 1 or left == m:
            return df.where(F.col(id_col) <= high)
