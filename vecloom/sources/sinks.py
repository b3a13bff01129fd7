"""Text sinks: one line a query with its neighbours' ids; one rank a line in node order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def ann_lines(knn: DataFrame) -> DataFrame:
    """(qid, value): the ids of a query's neighbours in order of rank, each followed by a blank."""
    ids = F.array_sort(F.collect_list(F.struct("rk", "vec_id")))  # at most k rows a query
    line = F.concat(F.concat_ws(" ", F.transform(ids, lambda x: x["vec_id"].cast("string"))), F.lit(" "))
    return knn.groupBy("qid").agg(line.alias("value"))


def write_ann(knn: DataFrame, path: str) -> None:
    ann_lines(knn).orderBy("qid").select("value").write.mode("overwrite").text(path)


@F.pandas_udf(StringType())
def percent_g(x: pd.Series) -> pd.Series:
    """As C prints %.14g. A UDF, as format_string's %g keeps trailing zeros and chooses the exponent form by other bounds."""
    return x.map(lambda v: f"{v:.14g}")


def rank_lines(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", percent_g("rank").alias("value"))


def write_ranks(ranks: DataFrame, path: str) -> None:
    rank_lines(ranks).orderBy("id").select("value").write.mode("overwrite").text(path)


def show_ann(knn: DataFrame, n: int = 20) -> None:
    ann_lines(knn).orderBy("qid").show(n, truncate=False)


def show_ranks(ranks: DataFrame, n: int = 20) -> None:
    rank_lines(ranks).orderBy("id").show(n, truncate=False)
