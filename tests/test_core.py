import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import connect, differences
from vecloom.functions import vectors as V
from vecloom.operators import graph, ivf, kmeans, matrix, pq
from vecloom.operators.exact import exact_knn, recall_at_k
from vecloom.operators.search import Params, build_index, search
from vecloom.plans import oracles
from vecloom.sources import binary, sinks
from vecloom.sources.tables import checked

VEC = "vec_id long, embedding array<float>"
ASK = "qid long, embedding array<float>"


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], VEC)


def asked(df):
    return df.withColumnRenamed("vec_id", "qid")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vector_functions(spark):
    assert one(spark, V.sq_l2(arr(1, 2), arr(4, 6))) == 25
    for i in range(1, 10):
        for j in range(i):
            assert one(spark, V.triangle_index(F.lit(i), F.lit(j))) == i * (i - 1) // 2 + j
    assert one(spark, V.nearest_code(arr(0), F.array(arr(1), arr(-1)))) == 0
    tri = F.array(arr(4, 9, 1), arr(2, 3, 5))
    codes = lambda *c: F.array(*[F.lit(x) for x in c])
    assert one(spark, V.sdc_distance(tri, codes(0, 2), codes(2, 1))) == 9 + 5
    assert one(spark, V.sdc_distance(tri, codes(1, 1), codes(1, 1))) == 0
    assert one(spark, V.reconstruct(F.array(F.array(arr(1), arr(2)), F.array(arr(3), arr(4))), codes(1, 0))) == [2, 3]
    assert one(spark, V.adc_distance(F.array(arr(1, 2), arr(3, 4)), codes(1, 0))) == 5


def test_ties_and_short_lists(spark):
    got = exact_knn(vecs(spark, [[1], [-1]]), asked(vecs(spark, [[0]])), 5).orderBy("rk").collect()
    assert [(r.rk, r.vec_id, r.dist) for r in got] == [(1, 0, 1.0), (2, 1, 1.0)]


def test_empty_cluster(spark):
    df = vecs(spark, [[1], [1], [3]])
    assert kmeans.kmeans(df, 2, tmin=1, tmax=1).centroids[0, 1, 0] == 0
    assert kmeans.kmeans(df, 2, tmin=1, tmax=1, empty="keep").centroids[0, 1, 0] == 1


def test_objective_falls_and_stops(spark):
    x = np.random.default_rng(0).normal(size=(300, 8))
    m = kmeans.kmeans(vecs(spark, x), 4, groups=2, tmin=2, tmax=50)
    assert all((a + 1e-9 >= b).all() for a, b in zip(m.history, m.history[1:])) and m.rounds.max() < 50


def test_search(spark):
    x = np.random.default_rng(1).normal(size=(400, 8))
    df = vecs(spark, x).cache()
    q = asked(df.where("vec_id < 10"))
    truth = exact_knn(df, q, 5)
    for p in (Params(metric="adc", knn=5, m=4, k=32), Params(metric="sdc", knn=5, m=4, k=32), Params(False, "adc", 5, 4, 32, 8, 4, nr=200), Params(False, "sdc", 5, 4, 32, 8, 4, nr=200)):
        assert recall_at_k(search(build_index(df, p), q), truth).first()["recall"] > 0.15
    model = ivf.ivf_train(df, 8, 4, 32, 200)
    full = ivf.ivf_search(ivf.ivf_encode(df, model), q, model, 5, w=99)
    assert full.count() == 50
    m = pq.pq_train(df, 4, 16)
    rec = {r.vec_id: np.array(r.embedding) for r in pq.reconstruct(pq.pq_encode(df, m), m).collect()}
    for r in pq.pq_search(pq.pq_encode(df, m), q, m, 3).collect():
        assert abs(((x[r.qid].astype(np.float32) - rec[r.vec_id]) ** 2).sum() - r.dist) < 1e-6


def test_invalid(spark):
    for bad in ([[1, 2], [1]], [[1, float("nan")]]):
        with pytest.raises(ValueError):
            checked(vecs(spark, bad))
    with pytest.raises(ValueError):
        checked(spark.createDataFrame([(1, None)], VEC))
    with pytest.raises(ValueError):
        kmeans.kmeans(vecs(spark, [[1, 2, 3]] * 3), 2, groups=2)
    with pytest.raises(ValueError):
        ivf.ivf_train(vecs(spark, [[1.0]] * 10), kc=8, nr=4)


def ranks(df):
    return {r.id: round(r["rank"], 6) for r in df.collect()}


def test_pagerank(spark):
    nodes = spark.range(3)
    cycle = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    assert ranks(graph.pagerank(nodes, cycle)) == {0: 0.333333, 1: 0.333333, 2: 0.333333}
    two = spark.createDataFrame([(0, 1)], "src long, dst long")
    got = ranks(graph.pagerank(spark.range(2), two, eps=1e-9, precision="double"))
    assert abs(got[0] - 1 / 2.85) < 1e-5
    dense = ranks(graph.pagerank_dense(graph.google_matrix(spark.range(2), two), eps=1e-9))
    assert abs(dense[0] - got[0]) < 1e-5
    many = spark.createDataFrame([(0, 1), (0, 1), (0, 2)], "src long, dst long")
    assert sorted(round(r.weight, 6) for r in graph.weighted_edges(many, 1.0).collect()) == [0.333333, 0.666667]
    with pytest.raises(RuntimeError):
        graph.pagerank(nodes, many, eps=0.0, max_iter=2, precision="double")


def test_gemm(spark):
    frame = lambda m: spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "i long, j long, v double")
    a, b = frame([[1, 2], [3, 4]]), frame([[5, 6], [7, 8]])
    for f in (matrix.gemm, lambda x, y: matrix.gemm_blocked(x, y, 1)):
        assert {(r.i, r.j): r.v for r in f(a, b).collect()} == {(0, 0): 19, (0, 1): 22, (1, 0): 43, (1, 1): 50}


def test_binary_and_sinks(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    binary.write_vectors(f"{tmp_path}/a.ds", x)
    assert [r.embedding for r in binary.read_vectors(spark, f"{tmp_path}/a.ds").orderBy("vec_id").collect()] == x.tolist()
    binary.write_graph(f"{tmp_path}/a.graph", 3, np.array([[0, 1], [2, 0]]))
    nodes, edges = binary.read_graph(spark, f"{tmp_path}/a.graph")
    assert nodes.count() == 3 and sorted((r.src, r.dst) for r in edges.collect()) == [(0, 1), (2, 0)]
    binary.write_matrix(f"{tmp_path}/a.matrix", np.array([[1.0, 2.0]]))
    assert [(r.i, r.j, r.v) for r in binary.read_matrix(spark, f"{tmp_path}/a.matrix").orderBy("j").collect()] == [(0, 0, 1.0), (0, 1, 2.0)]
    binary.write_gray_image(f"{tmp_path}/a.img", np.full((2, 3, 3), 7))
    assert {(r.y, r.x, r.v) for r in binary.read_image(spark, f"{tmp_path}/a.img").collect()} == {(y, x, 7.0) for y in range(2) for x in range(3)}
    with pytest.raises(FileNotFoundError):
        binary.read_vectors(spark, f"{tmp_path}/none.ds")
    knn = spark.createDataFrame([(0, 2, 5), (0, 1, 9)], "qid long, rk int, vec_id long")
    assert sinks.ann_lines(knn).first()["value"] == "9 5 "
    assert sinks.rank_lines(spark.createDataFrame([(0, 0.25)], "id long, rank double")).first()["value"] == "0.25"


@pytest.mark.parametrize("name", ["exact_knn", "kmeans_t3", "pq_search_sdc", "ivf_search_adc", "csc_offsets", "pagerank_opt", "gemm"])
def test_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    assert differences(spark, connect(d), d, entry.queries()[name], oracles.oracle_sql()[name]) == ""
