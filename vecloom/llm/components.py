"""Connected components by alternating stars; all state is in tables, none on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import discard, stash


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs (u, v): every v (with larger: only those over u), and u itself, is tied to the least of u and its v."""
    least = stash(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-least")
    tied = pairs.join(least, "u")
    out = tied.where(F.col("v") > F.col("u")) if larger else tied
    rest = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    done = stash(rest.union(own).where(F.col("a") != F.col("b")).distinct(), "cc-edges")
    discard(least)
    return done


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b), longs; root is the least node of its component. Self-links and repeated
    links do no harm; no links, no rows. A hub's rows can be split over tasks, as sums are written before they are joined."""
    e = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    before = _sum(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        large = _star(both.union(both.select("v", "u")), True)
        discard(e)
        e = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        discard(large)
        now = _sum(e)
        if now == before:
            roots = e.select(F.col("b").alias("node")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
        before = now
    raise RuntimeError("components did not settle")
