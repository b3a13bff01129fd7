"""Degrees, PageRank on arcs or on a dense matrix, with optional power extrapolation.

nodes (id), edges (src, dst); parallel arcs count as often as they occur.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.matrix import matvec
from vecloom.plans.session import cut

#: The iterations at which extrapolation saves and uses a vector.
SAVE_AT, JUMP_AT = 2, 8


def out_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    return nodes.select("id").join(d, "id", "left").fillna(0, ["deg"])


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    return nodes.select("id").join(d, "id", "left").fillna(0, ["deg"])


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def csc_offsets(edges: DataFrame, nodes: DataFrame, block: int = 65536) -> DataFrame:
    """(id, deg, start): exclusive prefix sums of the in-degrees. Sums run in blocks of ids, then over the blocks."""
    d = in_degree(edges, nodes).withColumn("b", F.floor(F.col("id") / block))
    before = Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy("b").agg(F.sum("deg").alias("t"))
    base = blocks.select("b", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = d.withColumn("own", F.coalesce(F.sum("deg").over(before), F.lit(0)))
    return inner.join(base, "b").select("id", "deg", (F.col("base") + F.col("own")).alias("start"))


def weighted_edges(edges: DataFrame, c: float) -> DataFrame:
    """Parallel arcs in one row, weight c x multiplicity / out-degree."""
    arcs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    deg = arcs.groupBy("src").agg(F.sum("n").alias("deg"))
    return arcs.join(deg, "src").select("src", "dst", (F.lit(c) * F.col("n") / F.col("deg")).alias("weight"))


def propagate(weights: DataFrame, nodes: DataFrame, ranks: DataFrame, kind: str = "double") -> DataFrame:
    """One multiplication, without the teleport; nodes without in-arcs get 0."""
    part = weights.join(ranks, weights.src == ranks.id).groupBy("dst").agg(F.sum(F.col("weight") * F.col("rank")).alias("part"))
    return nodes.join(part, nodes.id == part.dst, "left").select("id", F.coalesce("part", F.lit(0.0)).cast(kind).alias("rank"))


def csc_arrays(edges: DataFrame, nodes: DataFrame, c: float = 1.0, block: int = 65536) -> DataFrame:
    """(pos, src, dst, weight): the arcs by dst, then src, each at its place in the arrays of the compressed-column form; parallel arcs
    are one. Places are counted in blocks of sources, so that no task needs all arcs into one node."""
    arcs = weighted_edges(edges, c).withColumn("b", F.floor(F.col("src") / block))
    counts = arcs.groupBy("dst", "b").agg(F.count(F.lit(1)).alias("m"))
    own = F.sum("m").over(Window.partitionBy("dst").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    within = counts.select("dst", "b", F.coalesce(own, F.lit(0)).alias("before"))
    start = csc_offsets(arcs.select("src", "dst"), nodes).select(F.col("id").alias("dst"), "start")
    rank = F.row_number().over(Window.partitionBy("dst", "b").orderBy("src")) - 1
    placed = arcs.withColumn("rank", rank).join(within, ["dst", "b"]).join(start, "dst")
    return placed.select((F.col("start") + F.col("before") + F.col("rank")).alias("pos"), "src", "dst", "weight")


def extrapolate(ranks: DataFrame, saved: DataFrame, c: float, kind: str = "double") -> DataFrame:
    """x <- (x - c^6 l) / (1 - c^6), l the vector of six iterations before."""
    f = c ** (JUMP_AT - SAVE_AT)
    old = saved.select("id", F.col("rank").alias("old"))
    return ranks.join(old, "id").select("id", ((F.col("rank") - F.lit(f) * F.col("old")) / F.lit(1 - f)).cast(kind).alias("rank"))


def normalized(ranks: DataFrame) -> DataFrame:
    total = ranks.agg(F.sum(F.abs("rank"))).first()[0]
    return ranks.select("id", (F.col("rank").cast("double") / F.lit(total)).alias("rank"))


def _iterate(start: DataFrame, multiply, eps: float, max_iter: int, min_iter: int, c: float, opt: bool, kind: str, teleport: float | None) -> DataFrame:
    """teleport: number of nodes, where what is missing from a sum of 1 is spread over them. Each iteration is written once, as its
    plan would else hold all before it, twice each; one aggregation gives the sum of its ranks and the change of the iteration before."""
    x, saved = start, None
    before = start.select("id", F.col("rank").alias("before"))
    for k in range(1, max_iter + 1):
        y = cut(multiply(x).join(x.select("id", F.col("rank").alias("old")), "id").join(before, "id"))
        total, change = y.agg(F.sum(F.col("rank").cast("double")), F.sum(F.abs(F.col("old") - F.col("before")))).first()
        if k > max(1, min_iter) and (change or 0.0) < eps:  # of the iteration before
            return normalized(x)
        x, before = y.select("id", "rank"), y.select("id", F.col("old").alias("before"))
        if teleport:
            x = x.select("id", (F.col("rank") + F.lit((1.0 - (total or 0.0)) / teleport)).cast(kind).alias("rank"))
        if opt and k == SAVE_AT:
            saved = x
        if opt and k == JUMP_AT:
            x = extrapolate(x, saved, c, kind)
    if min_iter == max_iter:
        return normalized(x)
    change = x.join(before, "id").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
    if (change or 0.0) < eps:
        return normalized(x)
    raise RuntimeError(f"no convergence in {max_iter} iterations")


def pagerank(nodes: DataFrame, edges: DataFrame, c: float = 0.85, eps: float = 1e-5, precision: str = "single", opt: bool = False, max_iter: int = 200, iterations: int | None = None) -> DataFrame:
    """(id, rank), L1 norm 1. iterations: exactly so many, without a test. Each iteration shuffles the contributions once:
    the arcs stay where src puts them, and the new ranks come out by id."""
    kind = "float" if precision == "single" else "double"
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weights = weighted_edges(edges, c).repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)
    ids = nodes.select("id").repartition(parts, "id").persist(StorageLevel.MEMORY_AND_DISK)
    start = ids.select("id", F.lit(1.0 / n).cast(kind).alias("rank"))
    try:
        return _iterate(start, lambda x: propagate(weights, ids, x, kind), eps, iterations or max_iter, iterations or 1, c, opt, kind, n)
    finally:  # the ranks are written
        weights.unpersist()
        ids.unpersist()


def rank(nodes: DataFrame | None = None, edges: DataFrame | None = None, matrix: DataFrame | None = None, form: str = "sparse", precision: str = "single", opt: bool = False, **options) -> DataFrame:
    """One front for the ways of ranking: form 'sparse' (arcs) or 'dense' (a matrix, or the one that the arcs make), precision 'single' or
    'double', with extrapolation or not. The dense form has double precision only."""
    if form not in ("sparse", "dense") or precision not in ("single", "double"):
        raise ValueError(f"form {form!r}, precision {precision!r}")
    if form == "sparse":
        if nodes is None or edges is None:
            raise ValueError("the sparse form takes nodes and edges")
        return pagerank(nodes, edges, precision=precision, opt=opt, **options)
    if precision == "single":
        raise ValueError("the dense form has double precision")
    if matrix is None:
        if nodes is None or edges is None:
            raise ValueError("the dense form takes a matrix, or nodes and edges")
        matrix = google_matrix(nodes, edges, options.get("c", 0.85))
    return pagerank_dense(matrix, opt=opt, **options)


#: Nodes of a matrix that google_matrix makes: their ids are broadcast, and the result has their square.
DENSE_NODES = 1 << 16


def google_matrix(nodes: DataFrame, edges: DataFrame, c: float = 0.85) -> DataFrame:
    """(i, j, v), all pairs of nodes: rows of c x adjacency / out-degree + (1 - c) / n; dangling rows are 1 / n.
    The result itself has n x n rows; it exists for small graphs."""
    n = nodes.count()
    if n > DENSE_NODES:
        raise ValueError(f"{n} nodes are too many for a dense matrix; rank them in the sparse form")
    w = weighted_edges(edges, 1.0).select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight")
    has = edges.select(F.col("src").alias("i")).distinct().withColumn("has", F.lit(True))
    ids = nodes.select(F.collect_list("id").alias("ids"))
    grid = nodes.select(F.col("id").alias("i")).crossJoin(F.broadcast(ids)).select("i", F.explode("ids").alias("j"))
    p = F.when(F.col("has").isNull(), F.lit(1.0 / n)).otherwise(F.coalesce("weight", F.lit(0.0)))
    return grid.join(w, ["i", "j"], "left").join(has, "i", "left").select("i", "j", (F.lit(c) * p + F.lit((1 - c) / n)).alias("v"))


def pagerank_dense(matrix: DataFrame, c: float = 0.85, eps: float = 1e-5, opt: bool = False, max_iter: int = 200, iterations: int | None = None) -> DataFrame:
    """(id, rank) of a row-stochastic matrix (i, j, v) that holds the damping already; c matters to the extrapolation only."""
    n = matrix.select("i").distinct().count()
    if n == 0:
        return matrix.select(F.col("i").alias("id"), F.lit(0.0).alias("rank"))
    turned = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v").persist(StorageLevel.MEMORY_AND_DISK)
    start = turned.select(F.col("i").alias("id")).distinct().select("id", F.lit(1.0 / n).alias("rank"))

    def multiply(x: DataFrame) -> DataFrame:
        out = matvec(turned, x.select(F.col("id").alias("j"), F.col("rank").alias("x")))
        return out.select(F.col("i").alias("id"), F.col("y").alias("rank"))

    try:
        return _iterate(start, multiply, eps, iterations or max_iter, iterations or 1, c, opt, "double", None)
    finally:  # the ranks are written
        turned.unpersist()
