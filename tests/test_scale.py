"""Plans and kernels that matter at scale; formats through DataFrames; streams."""

import numpy as np
import pyarrow as pa
import pytest

from vecloom.functions import kernels
from vecloom.operators import exact, graph, ivf, kmeans, pq, topk
from vecloom.sources import binary
from vecloom.streaming import encode_stream


def table(spark, x, name="vec_id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, embedding array<float>")


def test_nearest_and_top_k_are_exact():
    r = np.random.default_rng(0)
    x = r.integers(-3, 4, (500, 4)).astype(float)  # many ties
    c = np.concatenate([x[:20], x[:20]])
    label, dist = kernels.nearest(x, c)
    full = kernels.distances(x, c)
    assert (label == full.argmin(1)).all() and (dist == full.min(1)).all()
    best = kernels.TopK(np.arange(10) + 100, 7)
    for part in np.array_split(np.arange(500), 6):
        best.add_rows(part, x[part], x[:10])
    got = best.batch().to_pydict()
    for q in range(10):
        d = ((x - x[q]) ** 2).sum(1)
        want = np.lexsort((np.arange(500), d))[:7]
        assert [i for i, k in zip(got["vec_id"], got["qid"], strict=True) if k == q + 100] == want.tolist()


def test_first_rows_of_many(spark, monkeypatch):
    monkeypatch.setattr(topk, "FEW", 10)
    monkeypatch.setattr(topk, "CUTS", 8)
    ids = spark.createDataFrame([(int(i) * 7 - 1000,) for i in np.random.default_rng(1).permutation(2000)], "vec_id long").repartition(6)
    for n in (11, 137, 1999, 2000, 5000):
        got = topk.first_rows(ids, n)
        assert sorted(r.vec_id for r in got.collect()) == [i * 7 - 1000 for i in range(min(n, 2000))]
        assert got.rdd.getNumPartitions() == 6  # no single task holds the rows


def test_vectors_are_checked_in_every_search(spark):
    good = table(spark, np.eye(4))
    model = pq.pq_train(good, 2, 2, tmin=1, tmax=1)
    asked = good.withColumnRenamed("vec_id", "qid")
    ragged = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0, 4.0, 5.0])], "vec_id long, embedding array<float>").coalesce(1)
    nan = spark.createDataFrame([(0, [float("nan")] * 4)], "vec_id long, embedding array<float>")
    null = spark.createDataFrame([(0, None)], "vec_id long, embedding array<float>")
    for bad in (ragged, nan, null):
        for search in (lambda: exact.exact_knn(bad, asked, 1), lambda: pq.pq_encode(bad, model), lambda: exact.exact_knn(good, bad.withColumnRenamed("vec_id", "qid"), 1)):
            with pytest.raises(Exception, match="vector|queries"):
                search().collect()


def test_local_and_distributed_training_agree(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(300, 8))
    df = table(spark, x).repartition(5)
    one = kmeans.kmeans(df, 9, groups=2, tmin=4, tmax=4)
    monkeypatch.setattr(kmeans, "LOCAL_BYTES", 1)
    two = kmeans.kmeans(df, 9, groups=2, tmin=4, tmax=4)
    assert np.allclose(one.centroids, two.centroids) and np.allclose(one.cost, two.cost)
    first = ivf.ivf_train(df, 6, 2, 5, 200, tmin=3, tmax=3)
    monkeypatch.setattr(ivf, "FEW", 1)
    second = ivf.ivf_train(df, 6, 2, 5, 200, tmin=3, tmax=3)
    assert np.allclose(first.coarse.centroids, second.coarse.centroids) and np.allclose(first.fine.centroids, second.fine.centroids)


def test_ivf_distances_are_those_of_tables(spark):
    x = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    df, q = table(spark, x).repartition(3), table(spark, x[:15] + 0.1, "qid")
    model = ivf.ivf_train(df, 7, 2, 16, 200, tmin=2, tmax=2)
    codes = ivf.ivf_encode(df, model)
    rows = {r.vec_id: (r.cell, r.codes) for r in codes.collect()}
    for metric in ("adc", "sdc"):
        got = ivf.ivf_search(codes, q, model, 5, 3, metric).collect()
        for r in q.collect():
            v = np.array(r.embedding, np.float64)
            cells = ivf.probes(v[None], model.coarse, 3)[0]
            want = []
            for i, (cell, own) in rows.items():
                if cell in cells:
                    lut = (pq.adc_luts if metric == "adc" else pq.sdc_luts)((v - model.coarse.centroids[0][cell])[None], model.fine)[0]
                    want.append((sum(lut[g][c] for g, c in enumerate(own)), i))
            want = sorted(want)[:5]
            mine = sorted((x.dist, x.vec_id) for x in got if x.qid == r.qid)
            assert np.allclose([d for d, _ in mine], [d for d, _ in want]) and len(mine) == len(want)


def test_many_queries_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(60, 4))
    df, q = table(spark, x), table(spark, x, "qid")
    whole = sorted(map(tuple, exact.exact_knn(df, q, 3).collect()))
    monkeypatch.setattr(exact, "QUERY_BYTES", 8 * 4 * 25)
    assert sorted(map(tuple, exact.exact_knn(df, q, 3).collect())) == whole
    monkeypatch.setattr(exact, "AT_ONCE", 10)
    assert sorted(map(tuple, exact.exact_knn(df, q, 3).collect())) == whole


def test_formats_through_frames(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(50, 3)).astype(np.float32)
    binary.save_vectors(table(spark, x).repartition(4), f"{tmp_path}/v.ds")
    assert [list(r.embedding) for r in binary.read_vectors(spark, f"{tmp_path}/v.ds").orderBy("vec_id").collect()] == x.tolist()
    edges = spark.createDataFrame([(2, 0), (0, 1), (0, 1)], "src long, dst long")
    binary.save_graph(spark.range(4), edges, f"{tmp_path}/g.graph")
    nodes, back = binary.read_graph(spark, f"{tmp_path}/g.graph")
    assert nodes.count() == 4 and sorted(map(tuple, back.collect())) == [(0, 1), (0, 1), (2, 0)]
    cells = spark.createDataFrame([(0, 0, 0.5), (2, 1, -1.25)], "i long, j long, v double")
    binary.save_matrix(cells, f"{tmp_path}/m.matrix")
    assert {(r.i, r.j): r.v for r in binary.read_matrix(spark, f"{tmp_path}/m.matrix").collect() if r.v} == {(0, 0): 0.5, (2, 1): -1.25}
    binary.save_vectors(table(spark, x).limit(0), f"{tmp_path}/none.ds")
    assert binary.header(f"{tmp_path}/none.ds") == (0, 0)


def test_ranking_front(spark):
    nodes = spark.range(4)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    sparse = {r.id: r.rank for r in graph.rank(nodes, edges, precision="double", iterations=4).collect()}
    dense = {r.id: r.rank for r in graph.rank(nodes, edges, form="dense", precision="double", iterations=4).collect()}
    assert all(abs(sparse[i] - dense[i]) < 1e-9 for i in range(4)) and abs(sum(sparse.values()) - 1) < 1e-12
    for bad in ({"form": "x"}, {"form": "dense"}, {"precision": "half"}):
        with pytest.raises(ValueError):
            graph.rank(nodes, edges, **bad)
    with pytest.raises(RuntimeError):
        graph.rank(nodes, edges, precision="double", eps=1e-15, max_iter=2)
    arrays = graph.csc_arrays(edges, nodes, block=1).orderBy("pos").collect()
    assert [(r.pos, r.src, r.dst) for r in arrays] == [(0, 2, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3)]


def test_stream_of_vectors(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(40, 4)).astype(np.float32)
    df = table(spark, x)
    model = pq.pq_train(df, 2, 4, tmin=1, tmax=1)
    df.write.parquet(f"{tmp_path}/in")
    stream = encode_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), model)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination(120)
    got = {r.vec_id: list(r.codes) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.vec_id: list(r.codes) for r in pq.pq_encode(df, model).collect()} and len(got) == 40


def test_matrix_kernel():
    assert kernels.matrix(pa.array([[1.0, 2.0], [3.0, 4.0]]).slice(1), 2).tolist() == [[3.0, 4.0]]
