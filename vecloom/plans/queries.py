"""The registered queries. Each takes (spark, sf_dir) and returns a DataFrame; plans/oracles.py has the same results as SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import exact, graph, ivf, kmeans, matrix, pq, search, topk
from vecloom.plans.session import shared_dir
from vecloom.sources import binary
from vecloom.sources.sinks import ann_lines, rank_lines
from vecloom.sources.tables import dense_ids, load
from vecloom.sources.tables import vectors as as_vectors

#: Sizes that fit the test tables: groups, codes, cells, probes, learning rows, k-means rounds, neighbours, dimension.
M, K, KC, W, NR, T, KNN, DIM = 8, 16, 16, 4, 200, 3, 5, 64
#: The queries of a search are all rows whose id this number divides, against all rows.
EACH = 100
WIDTH = DIM // M
ROUNDS = {"tmin": T, "tmax": T}
#: PageRank iterations of the queries that fix them; enough to pass the extrapolation.
STEPS = 10


def base(spark: SparkSession, d: str) -> DataFrame:
    return as_vectors(load(spark, d, "embeddings"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).where(F.col("vec_id") % EACH == 0).withColumnRenamed("vec_id", "qid")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def exact_knn(spark, d):
    return rounded(exact.exact_knn(base(spark, d), asked(spark, d), KNN), "dist")


def exact_nn1(spark, d):
    return rounded(topk.nearest_one(exact.exact_knn(base(spark, d), asked(spark, d), 1)), "dist")


def exact_top2(spark, d):
    return rounded(exact.exact_knn(base(spark, d), asked(spark, d), 2), "dist")


def ann_text(spark, d):
    return ann_lines(exact.exact_knn(base(spark, d), asked(spark, d), KNN))


def first_vector(spark, d) -> list[float]:
    return [float(x) for x in base(spark, d).where("vec_id = 0").first()["embedding"]]


def constant(values: list[float]):
    return F.array(*[F.lit(x) for x in values])


def sq_l2(spark, d):
    y = constant(first_vector(spark, d))
    return base(spark, d).select("vec_id", F.round(V.sq_l2(F.col("embedding"), y), 6).alias("dist"))


def residual(spark, d):
    y = constant(first_vector(spark, d))
    r = V.residual(F.col("embedding"), y)
    return base(spark, d).select("vec_id", F.posexplode(F.transform(r, lambda x: F.round(x, 6))).alias("pos", "v"))


def vec_functions(spark, d):
    """Sum, norms and sums of squares of each row, and of a row plus itself."""
    e = F.col("embedding")
    return base(spark, d).select(
        "vec_id", F.round(V.vec_sum(e), 6).alias("total"), F.round(V.l1_norm(e), 6).alias("l1"), F.round(V.sum_squares(e), 6).alias("squares"),
        F.round(V.l1_norm(V.vec_add(e, e)), 6).alias("double_l1"), F.round(V.vec_sum(V.add_scalar(e, F.lit(1.0))), 6).alias("shifted"),
        F.round(V.l1_norm(V.l1_normalize(e)), 6).alias("unit"), F.round(V.sum_squares(V.subvector(e, 1, WIDTH)), 6).alias("part"),
    )


def start_book(spark, d) -> kmeans.Model:
    """The first K rows as codebook, without training."""
    return pq.pq_train(base(spark, d), M, K, tmin=0, tmax=0)


def codes_long(codes: DataFrame) -> DataFrame:
    return codes.select("vec_id", F.posexplode("codes").alias("grp", "code"))


def book_long(model: kmeans.Model, spark, digits: int = 6) -> DataFrame:
    long = model.frame(spark).select("grp", "code", F.posexplode("centroid").alias("pos", "v"))
    return rounded(long, "v", digits=digits)


def pq_encode_init(spark, d):
    return codes_long(pq.pq_encode(base(spark, d), start_book(spark, d)))


def coarse_assign(spark, d):
    coarse = kmeans.kmeans(base(spark, d), KC, tmin=0, tmax=0)
    return kmeans.assign(base(spark, d), coarse, "cell").select("vec_id", "cell")


def kmeans_step(spark, d):
    return book_long(kmeans.kmeans(base(spark, d), K, groups=M, tmin=1, tmax=1), spark)


def trained(spark, d) -> kmeans.Model:
    return pq.pq_train(base(spark, d), M, K, **ROUNDS)


def kmeans_t3(spark, d):
    return codes_long(pq.pq_encode(base(spark, d), trained(spark, d)))


def pq_train(spark, d):
    return book_long(trained(spark, d), spark)


def wcss(spark, d):
    cost = trained(spark, d).cost
    return spark.createDataFrame([(g, round(float(c), 6)) for g, c in enumerate(cost)], "grp int, cost double")


def sdc_table(spark, d):
    return rounded(pq.sdc_table(trained(spark, d).frame(spark)), "dist")


def adc_table(spark, d):
    return rounded(pq.adc_table(asked(spark, d), trained(spark, d)), "dist")


def reconstruct(spark, d):
    model = trained(spark, d)
    full = pq.reconstruct(pq.pq_encode(base(spark, d), model), model)
    return full.select("vec_id", F.posexplode(F.transform("embedding", lambda x: F.round(x, 6))).alias("pos", "v"))


def _pq(spark, d, metric):
    model = trained(spark, d)
    return rounded(pq.pq_search(pq.pq_encode(base(spark, d), model), asked(spark, d), model, KNN, metric), "dist")


def pq_search_adc(spark, d):
    return _pq(spark, d, "adc")


def pq_search_sdc(spark, d):
    return _pq(spark, d, "sdc")


def recall_at_k(spark, d):
    return exact.recall_at_k(_pq(spark, d, "adc"), exact.exact_knn(base(spark, d), asked(spark, d), KNN))


def cells(spark, d) -> ivf.IvfModel:
    return ivf.ivf_train(base(spark, d), KC, M, K, NR, **ROUNDS)


def ivf_encode(spark, d):
    codes = ivf.ivf_encode(base(spark, d), cells(spark, d))
    return codes.select("vec_id", "cell", F.posexplode("codes").alias("grp", "code"))


def ivf_lists(spark, d):
    return ivf.inverted_lists(ivf.ivf_encode(base(spark, d), cells(spark, d)), KC)


def _ivf(spark, d, metric):
    model = cells(spark, d)
    return rounded(ivf.ivf_search(ivf.ivf_encode(base(spark, d), model), asked(spark, d), model, KNN, W, metric), "dist")


def ivf_search_adc(spark, d):
    return _ivf(spark, d, "adc")


def ivf_search_sdc(spark, d):
    return _ivf(spark, d, "sdc")


def trade(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customer nation to supplier nation, an arc an order line."""
    arcs = (
        load(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
        .join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(load(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    )
    return load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")), arcs


#: Added to supplier keys, beyond all customer keys.
SUPPLIERS = 1_000_000_000_000


def supply(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customer to supplier, ids from 0; suppliers have no arcs out."""
    arcs = (
        load(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
        .join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + F.lit(SUPPLIERS)).alias("dst"))
    )
    return dense_ids(arcs)


def out_degree(spark, d):
    nodes, edges = supply(spark, d)
    return graph.out_degree(edges, nodes)


def in_degree(spark, d):
    nodes, edges = supply(spark, d)
    return graph.in_degree(edges, nodes)


def dangling(spark, d):
    nodes, edges = supply(spark, d)
    return graph.dangling(edges, nodes)


def csc_offsets(spark, d):
    nodes, edges = supply(spark, d)
    return graph.csc_offsets(edges, nodes)


def _ranks(spark, d, source, **options):
    nodes, edges = source(spark, d)
    return rounded(graph.pagerank(nodes, edges, **options), "rank", digits=8)


def pagerank_step(spark, d):
    return _ranks(spark, d, trade, precision="double", iterations=1)


def pagerank_sparse(spark, d):
    return _ranks(spark, d, supply, precision="double", iterations=STEPS)


def pagerank_single(spark, d):
    nodes, edges = trade(spark, d)
    return rounded(graph.pagerank(nodes, edges, precision="single", iterations=STEPS), "rank", digits=5)


def pagerank_opt(spark, d):
    return _ranks(spark, d, trade, precision="double", opt=True, iterations=STEPS)


def pagerank_single_opt(spark, d):
    nodes, edges = trade(spark, d)
    return rounded(graph.pagerank(nodes, edges, precision="single", opt=True, iterations=STEPS), "rank", digits=5)


def pagerank_dispatch(spark, d):
    """The four ways that the front offers for one graph, side by side."""
    nodes, edges = trade(spark, d)
    ways = [("sparse", "single", False), ("sparse", "double", True), ("dense", "double", False), ("dense", "double", True)]
    made = [graph.rank(nodes, edges, form=f, precision=p, opt=o, iterations=STEPS).select(F.lit(f"{f} {p}{' opt' * o}").alias("way"), "id", "rank") for f, p, o in ways]
    return rounded(exact.union_blocks(made, None), "rank", digits=5)


def csc_arrays(spark, d):
    nodes, edges = supply(spark, d)
    return rounded(graph.csc_arrays(edges, nodes, 0.85), "weight", digits=8)


def ranks_text(spark, d):
    """A text line a node, in order of id, with 14 digits as C prints them."""
    nodes, edges = trade(spark, d)
    return rank_lines(rounded(graph.pagerank(nodes, edges, precision="double", iterations=1), "rank", digits=8))


def search_front(spark, d):
    """The four ways of searching through the one front."""
    out = []
    for exhaustive in (True, False):
        for metric in ("adc", "sdc"):
            p = search.Params(exhaustive=exhaustive, metric=metric, knn=KNN, m=M, k=K, kc=KC, w=W, nr=NR, **ROUNDS)
            found = search.search(search.build_index(base(spark, d), p), asked(spark, d))
            out.append(found.select(F.lit(f"{'whole' if exhaustive else 'cells'} {metric}").alias("way"), "qid", "rk", "vec_id", "dist"))
    return rounded(exact.union_blocks(out, None), "dist")


def literal_table(rows) -> Column:
    return F.array(*[constant([float(x) for x in r]) for r in rows])


def pq_columns(spark, d):
    """Distances of all rows to the row of id 0 from codes, as column expressions: symmetric and asymmetric."""
    model = trained(spark, d)
    codes = pq.pq_encode(base(spark, d), model)
    own = F.array(*[F.lit(int(c)) for c in codes.where("vec_id = 0").first()["codes"]])
    triangles = literal_table([[t[i, j] for i in range(K) for j in range(i)] for t in pq.sdc_matrix(model)])
    lut = literal_table(pq.adc_luts(np.array([first_vector(spark, d)]), model)[0])
    return codes.select("vec_id", F.round(V.sdc_distance(triangles, F.col("codes"), own), 6).alias("sdc"), F.round(V.adc_distance(lut, F.col("codes")), 6).alias("adc"))


def pair_index(spark, d):
    """Places of pairs of numbers in a lower triangle, the larger first."""
    hi, lo = V.orient_pair(F.col("c_custkey") % 97, F.col("c_nationkey").cast("long"))
    return load(spark, d, "customer").select("c_custkey", hi.alias("hi"), lo.alias("lo"), V.triangle_index(hi, lo).alias("place"))


def _file(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def vector_file(spark, d):
    """All embeddings through the file format of vectors."""
    binary.save_vectors(base(spark, d), path := _file(spark, "vectors.ds"))
    return binary.read_vectors(spark, path).select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", F.round(F.col("v").cast("double"), 6).alias("v"))


def graph_file(spark, d):
    """The trade arcs through the file format of graphs: arcs between each two nodes."""
    nodes, edges = trade(spark, d)
    binary.save_graph(nodes, edges, path := _file(spark, "arcs.graph"))
    return binary.read_graph(spark, path)[1].groupBy("src", "dst").agg(F.count(F.lit(1)).alias("arcs"))


def matrix_file(spark, d):
    """The dense ranking matrix through the file format of matrices."""
    binary.save_matrix(graph.google_matrix(*trade(spark, d)), path := _file(spark, "dense.matrix"))
    return rounded(binary.read_matrix(spark, path), "v", digits=8)


def image_file(spark, d):
    """All embeddings as a picture: its format has the layout of vectors, a vector a row."""
    binary.save_vectors(base(spark, d), path := _file(spark, "picture.img"))
    return binary.read_image(spark, path).select("y", "x", F.round(F.col("v").cast("double"), 6).alias("v"))


def pagerank_converged(spark, d):
    """Until the L1 change is under 1e-10; compared with a long fixed iteration."""
    return _ranks(spark, d, trade, precision="double", eps=1e-10)


def google_matrix(spark, d):
    return rounded(graph.google_matrix(*trade(spark, d)), "v", digits=8)


def pagerank_dense(spark, d):
    return rounded(graph.pagerank_dense(graph.google_matrix(*trade(spark, d)), iterations=STEPS), "rank", digits=8)


def pagerank_dense_opt(spark, d):
    return rounded(graph.pagerank_dense(graph.google_matrix(*trade(spark, d)), opt=True, iterations=STEPS), "rank", digits=8)


def whole_matrix(spark, d) -> DataFrame:
    """The embeddings as a matrix (i, j, v): a row a vector."""
    e = base(spark, d)
    return e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("v"))


def turned(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def gemm(spark, d):
    """The product of the transposed matrix of all embeddings and itself."""
    a = whole_matrix(spark, d)
    return rounded(matrix.gemm(turned(a), a), "v")


def gemm_blocked(spark, d):
    a = whole_matrix(spark, d)
    return rounded(matrix.gemm_blocked(turned(a), a), "v").where("v <> 0")


def matvec(spark, d):
    """All embeddings times the one of id 0."""
    a = whole_matrix(spark, d)
    return rounded(matrix.matvec(a, a.where("i = 0").select("j", F.col("v").alias("x"))), "y")


def balances(spark, d) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))


def l1_norm(spark, d):
    return rounded(matrix.vector_stats(balances(spark, d)).select("total", "l1"), "total", "l1", digits=2)


def sum_squares(spark, d):
    return matrix.vector_stats(balances(spark, d)).select(F.round(F.col("squares") / 1e6, 4).alias("squares"))


def l1_diff(spark, d):
    a = balances(spark, d)
    return rounded(matrix.l1_diff(a, a.select("id", (F.col("x") * 2 - 1).alias("x"))), "l1_diff", digits=2)


def l1_normalize(spark, d):
    return rounded(matrix.l1_normalize(balances(spark, d)), "x", digits=9)


def vec_poly(spark, d):
    x = F.col("c_acctbal") / 1000
    return load(spark, d, "customer").select("c_custkey", F.round(V.poly(x, 2.0), 6).alias("y"), F.round(V.power(x, 3), 4).alias("cube"))


def leibniz_pi(spark, d):
    return rounded(matrix.leibniz_pi(spark, 10_000_000), "pi")


REGISTERED = [
    exact_knn, exact_nn1, exact_top2, ann_text, sq_l2, residual, vec_functions, pq_encode_init, coarse_assign, kmeans_step, kmeans_t3, pq_train, wcss,
    sdc_table, adc_table, reconstruct, pq_search_adc, pq_search_sdc, recall_at_k, ivf_encode, ivf_lists, ivf_search_adc, ivf_search_sdc,
    out_degree, in_degree, dangling, csc_offsets, pagerank_step, pagerank_sparse, pagerank_single, pagerank_opt, pagerank_converged,
    pagerank_single_opt, pagerank_dispatch, csc_arrays, ranks_text, search_front, pq_columns, pair_index, vector_file, graph_file, matrix_file, image_file,
    google_matrix, pagerank_dense, pagerank_dense_opt, gemm, gemm_blocked, matvec, l1_norm, sum_squares, l1_diff, l1_normalize, vec_poly, leibniz_pi,
]


def queries() -> dict:
    return {f.__name__: f for f in REGISTERED}
