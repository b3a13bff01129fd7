"""Parquet tables and checks of vector columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", as_id: str = "vec_id") -> DataFrame:
    """Two columns, id and embedding, of any table."""
    return df.select(F.col(id_col).cast("long").alias(as_id), F.col(vec_col).alias("embedding"))


def checked(df: DataFrame, dim: int | None = None, id_col: str = "vec_id") -> tuple[DataFrame, int]:
    """The table and its dimension. Null ids or vectors, NaN, and vectors of unequal length raise ValueError."""
    e = F.col("embedding")
    bad = e.isNull() | F.col(id_col).isNull() | F.exists(e, lambda x: x.isNull() | F.isnan(x))
    row = df.agg(F.min(F.size(e)).alias("lo"), F.max(F.size(e)).alias("hi"), F.count_if(bad).alias("bad")).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} vectors are null or hold null or NaN")
    if row["lo"] is None:
        return df, dim or 0
    if row["lo"] != row["hi"] or (dim is not None and row["lo"] != dim):
        raise ValueError(f"vector lengths {row['lo']} to {row['hi']}, expected {dim or 'one length'}")
    return df, row["lo"]


def dense_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with ids 0..N-1 in order of the old ids; nodes keep the old id as label."""
    ids = edges.select(F.col("src").alias("label")).union(edges.select("dst")).distinct()
    parts = ids.repartitionByRange("label").withColumn("p", F.spark_partition_id()).persist()
    counts = parts.groupBy("p").count().collect()  # one row a partition
    before, total = {}, 0
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        before[p], total = total, total + n
    from pyspark.sql import Window

    start = parts.sparkSession.createDataFrame([(p, n) for p, n in before.items()] or [(0, 0)], "p int, base long")
    rank = F.row_number().over(Window.partitionBy("p").orderBy("label")) - 1
    nodes = parts.withColumn("r", rank).join(F.broadcast(start), "p").select((F.col("base") + F.col("r")).alias("id"), "label")
    src, dst = (nodes.select(F.col("label").alias(c), F.col("id").alias(f"{c}_id")) for c in ("src", "dst"))
    return nodes, edges.join(src, "src").join(dst, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
