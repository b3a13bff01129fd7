"""The registered queries as DuckDB SQL. Training and ranking are unrolled: one set of common tables an iteration."""

from __future__ import annotations

from vecloom.plans.queries import DIM, EACH, K, KC, KNN, M, NR, STEPS, SUPPLIERS, T, W, WIDTH

Ctes = list[tuple[str, str]]


def with_all(ctes: Ctes, last: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes) + "\n" + last


LONG = f"SELECT vec_id, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range({DIM}) r(i)"
PARTS = f"SELECT vec_id, i // {WIDTH} AS grp, i % {WIDTH} AS pos, v FROM ({LONG})"
WHOLE = f"SELECT vec_id, 0 AS grp, i AS pos, v FROM ({LONG})"


def nearest(points: str, book: str) -> str:
    dist = f"SELECT p.vec_id, p.grp, c.code, sum((p.v - c.v) * (p.v - c.v)) AS d FROM {points} p JOIN {book} c ON p.grp = c.grp AND p.pos = c.pos GROUP BY ALL"
    return f"SELECT vec_id, grp, code, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, grp ORDER BY d, code) AS rn FROM ({dist})) WHERE rn = 1"


def train(points: str, name: str, k: int, rounds: int) -> Ctes:
    """name_c0 ... name_c{rounds}: centroids (grp, code, pos, v)."""
    out = [(f"{name}_c0", f"SELECT grp, CAST(vec_id AS INT) AS code, pos, v FROM {points} WHERE vec_id < {k}")]
    for t in range(1, rounds + 1):
        out.append((f"{name}_a{t}", nearest(points, f"{name}_c{t - 1}")))
        mean = f"SELECT a.grp, a.code, p.pos, avg(p.v) AS v FROM {name}_a{t} a JOIN {points} p ON a.vec_id = p.vec_id AND a.grp = p.grp GROUP BY ALL"
        out.append((f"{name}_c{t}", f"SELECT c.grp, c.code, c.pos, coalesce(m.v, 0) AS v FROM {name}_c0 c LEFT JOIN ({mean}) m ON c.grp = m.grp AND c.code = m.code AND c.pos = m.pos"))
    return out


def first_k(source: str, k: int, dist: str = "dist") -> str:
    ranked = f"SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY {dist}, vec_id) AS INT) AS rk, vec_id, {dist} AS dist FROM ({source})"
    return f"SELECT qid, rk, vec_id, round(dist, 6) AS dist FROM ({ranked}) WHERE rk <= {k}"


PAIRS = f"SELECT q.vec_id AS qid, e.vec_id, sum((q.v - e.v) * (q.v - e.v)) AS dist FROM ({LONG}) q JOIN ({LONG}) e ON q.i = e.i WHERE q.vec_id % {EACH} = 0 GROUP BY ALL"
PQ: Ctes = [("pts", PARTS), *train("pts", "b", K, T), ("codes", nearest("pts", f"b_c{T}"))]
ADC = f"SELECT p.vec_id AS qid, p.grp, c.code, sum((p.v - c.v) * (p.v - c.v)) AS dist FROM pts p JOIN b_c{T} c ON p.grp = c.grp AND p.pos = c.pos WHERE p.vec_id % {EACH} = 0 GROUP BY ALL"
SDC = f"SELECT x.grp, x.code AS c1, y.code AS c2, sum((x.v - y.v) * (x.v - y.v)) AS dist FROM b_c{T} x JOIN b_c{T} y ON x.grp = y.grp AND x.pos = y.pos GROUP BY ALL"
ADC_PAIRS = "SELECT l.qid, c.vec_id, sum(l.dist) AS dist FROM lut l JOIN codes c ON l.grp = c.grp AND l.code = c.code GROUP BY ALL"
SDC_PAIRS = f"SELECT q.vec_id AS qid, c.vec_id, sum(s.dist) AS dist FROM codes q JOIN sdc s ON q.grp = s.grp AND q.code = s.c1 JOIN codes c ON c.grp = s.grp AND c.code = s.c2 WHERE q.vec_id % {EACH} = 0 GROUP BY ALL"

IVF: Ctes = [
    ("whole", WHOLE), ("learn", f"SELECT * FROM whole WHERE vec_id < {NR}"), *train("learn", "g", KC, T),
    ("lab", f"SELECT vec_id, code AS cell FROM ({nearest('whole', f'g_c{T}')})"),
    ("res", f"SELECT w.vec_id, w.pos // {WIDTH} AS grp, w.pos % {WIDTH} AS pos, w.v - c.v AS v FROM whole w JOIN lab l ON w.vec_id = l.vec_id JOIN g_c{T} c ON c.code = l.cell AND c.pos = w.pos"),
    ("rlearn", f"SELECT * FROM res WHERE vec_id < {NR}"), *train("rlearn", "f", K, T),
    ("codes", nearest("res", f"f_c{T}")),
    ("cd", f"SELECT q.vec_id AS qid, c.code AS cell, sum((q.v - c.v) * (q.v - c.v)) AS d FROM whole q JOIN g_c{T} c ON q.pos = c.pos WHERE q.vec_id % {EACH} = 0 GROUP BY ALL"),
    ("probe", f"SELECT qid, cell FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, cell) AS rn FROM cd) WHERE rn <= {W}"),
    ("qres", f"SELECT p.qid, p.cell, q.pos // {WIDTH} AS grp, q.pos % {WIDTH} AS pos, q.v - c.v AS v FROM probe p JOIN whole q ON q.vec_id = p.qid JOIN g_c{T} c ON c.code = p.cell AND c.pos = q.pos"),
    ("lut", f"SELECT q.qid, q.cell, q.grp, c.code, sum((q.v - c.v) * (q.v - c.v)) AS dist FROM qres q JOIN f_c{T} c ON q.grp = c.grp AND q.pos = c.pos GROUP BY ALL"),
]
LISTED = "SELECT l.qid, c.vec_id, sum(l.dist) AS dist FROM {lut} l JOIN lab b ON b.cell = l.cell JOIN codes c ON c.vec_id = b.vec_id AND c.grp = l.grp AND c.code = l.code GROUP BY ALL"
SYMMETRIC: Ctes = [
    ("own", "SELECT qid, cell, grp, code FROM (SELECT *, row_number() OVER (PARTITION BY qid, cell, grp ORDER BY dist, code) AS rn FROM lut) WHERE rn = 1"),
    ("slut", f"SELECT o.qid, o.cell, o.grp, y.code, sum((x.v - y.v) * (x.v - y.v)) AS dist FROM own o JOIN f_c{T} x ON x.grp = o.grp AND x.code = o.code JOIN f_c{T} y ON y.grp = x.grp AND y.pos = x.pos GROUP BY ALL"),
]

TRADE: Ctes = [
    ("nodes", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation"),
    ("edges", "SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"),
]
SUPPLY: Ctes = [
    ("raw", f"SELECT o_custkey AS src, l_suppkey + {SUPPLIERS} AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    ("labels_", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT src AS label FROM raw UNION SELECT dst FROM raw)"),
    ("nodes", "SELECT id FROM labels_"),
    ("edges", "SELECT s.id AS src, d.id AS dst FROM raw JOIN labels_ s ON raw.src = s.label JOIN labels_ d ON raw.dst = d.label"),
]
WEIGHTS: Ctes = [("w", "SELECT src, dst, count(*) / any_value(deg) AS p FROM edges JOIN (SELECT src AS s, count(*) AS deg FROM edges GROUP BY 1) ON src = s GROUP BY src, dst")]
GOOGLE: Ctes = [
    *TRADE, *WEIGHTS, ("n", "SELECT count(*) AS n FROM nodes"),
    ("p", "SELECT a.id AS i, b.id AS j, 0.85 * (CASE WHEN a.id IN (SELECT src FROM edges) THEN coalesce(w.p, 0) ELSE 1.0 / n END) + 0.15 / n AS v FROM nodes a CROSS JOIN nodes b CROSS JOIN n LEFT JOIN w ON w.src = a.id AND w.dst = b.id"),
]


def ranks(graph: Ctes, steps: int, opt: bool = False, single: bool = False, dense: bool = False) -> str:
    kind = "FLOAT" if single else "DOUBLE"
    ctes = [*graph, *([] if dense else [*WEIGHTS, ("n", "SELECT count(*) AS n FROM nodes")]), ("x0", f"SELECT id, CAST(1.0 / n AS {kind}) AS r FROM nodes, n")]
    for k in range(1, steps + 1):
        x = f"x{k - 1}"
        if dense:
            new = f"SELECT j AS id, sum(v * r) AS r FROM p JOIN {x} ON i = {x}.id GROUP BY 1"
        else:
            ctes.append((f"y{k}", f"SELECT nodes.id, CAST(coalesce(s.r, 0) AS {kind}) AS r FROM nodes LEFT JOIN (SELECT dst, sum(0.85 * p * r) AS r FROM w JOIN {x} ON src = {x}.id GROUP BY 1) s ON nodes.id = s.dst"))
            new = f"SELECT id, CAST(r + (1 - (SELECT sum(CAST(r AS DOUBLE)) FROM y{k})) / n AS {kind}) AS r FROM y{k}, n"
        if opt and k == 8:
            ctes.append(("z", new))
            new = f"SELECT z.id, CAST((z.r - pow(0.85, 6) * x2.r) / (1 - pow(0.85, 6)) AS {kind}) AS r FROM z JOIN x2 ON z.id = x2.id"
        ctes.append((f"x{k}", new))
    return with_all(ctes, f"SELECT id, round(CAST(r AS DOUBLE) / (SELECT sum(abs(CAST(r AS DOUBLE))) FROM x{steps}), {5 if single else 8}) AS rank FROM x{steps}")


WHOLE_MATRIX = f"SELECT vec_id AS i, CAST(i AS BIGINT) AS j, v FROM ({LONG})"


def oracle_sql() -> dict[str, str]:
    book = "SELECT grp, code, pos, round(v, 6) AS v FROM"
    return {
        "exact_knn": first_k(PAIRS, KNN),
        "exact_nn1": f"SELECT qid, vec_id, dist FROM ({first_k(PAIRS, 1)})",
        "exact_top2": first_k(PAIRS, 2),
        "ann_text": f"SELECT qid, string_agg(CAST(vec_id AS VARCHAR), ' ' ORDER BY rk) || ' ' AS value FROM ({first_k(PAIRS, KNN)}) GROUP BY 1",
        "sq_l2": f"SELECT e.vec_id, round(sum((e.v - q.v) * (e.v - q.v)), 6) AS dist FROM ({LONG}) e JOIN ({LONG}) q ON e.i = q.i AND q.vec_id = 0 GROUP BY 1",
        "residual": f"SELECT e.vec_id, e.i AS pos, round(e.v - q.v, 6) AS v FROM ({LONG}) e JOIN ({LONG}) q ON e.i = q.i AND q.vec_id = 0",
        "vec_functions": f"SELECT vec_id, round(sum(v), 6) AS total, round(sum(abs(v)), 6) AS l1, round(sum(v * v), 6) AS squares, round(sum(abs(v + v)), 6) AS double_l1, round(sum(v + 1), 6) AS shifted, round(sum(abs(v)) / sum(abs(v)), 6) AS unit, round(sum(CASE WHEN i // {WIDTH} = 1 THEN v * v ELSE 0 END), 6) AS part FROM ({LONG}) GROUP BY 1",
        "pq_encode_init": with_all([("pts", PARTS), *train("pts", "b", K, 0)], f"SELECT vec_id, grp, code FROM ({nearest('pts', 'b_c0')})"),
        "coarse_assign": with_all([("pts", WHOLE), *train("pts", "b", KC, 0)], f"SELECT vec_id, code AS cell FROM ({nearest('pts', 'b_c0')})"),
        "kmeans_step": with_all([("pts", PARTS), *train("pts", "b", K, 1)], f"{book} b_c1"),
        "kmeans_t3": with_all(PQ, "SELECT vec_id, grp, code FROM codes"),
        "pq_train": with_all(PQ, f"{book} b_c{T}"),
        "wcss": with_all(PQ, "SELECT grp, round(sum(d), 6) AS cost FROM codes GROUP BY 1"),
        "sdc_table": with_all(PQ, f"SELECT grp, c1, c2, round(dist, 6) AS dist FROM ({SDC}) WHERE c1 > c2"),
        "adc_table": with_all(PQ, f"SELECT qid, grp, code, round(dist, 6) AS dist FROM ({ADC})"),
        "reconstruct": with_all(PQ, f"SELECT a.vec_id, a.grp * {WIDTH} + c.pos AS pos, round(c.v, 6) AS v FROM codes a JOIN b_c{T} c ON a.grp = c.grp AND a.code = c.code"),
        "pq_search_adc": with_all([*PQ, ("lut", ADC)], first_k(ADC_PAIRS, KNN)),
        "pq_search_sdc": with_all([*PQ, ("sdc", SDC)], first_k(SDC_PAIRS, KNN)),
        "recall_at_k": with_all(
            [*PQ, ("lut", ADC), ("found", first_k(ADC_PAIRS, KNN)), ("truth", first_k(PAIRS, KNN))],
            "SELECT count(f.qid) AS hits, count(*) AS total, round(count(f.qid) / count(*), 6) AS recall FROM truth t LEFT JOIN found f ON t.qid = f.qid AND t.vec_id = f.vec_id",
        ),
        "ivf_encode": with_all(IVF, "SELECT c.vec_id, l.cell, c.grp, c.code FROM codes c JOIN lab l ON c.vec_id = l.vec_id"),
        "ivf_lists": with_all(
            IVF, f"SELECT cell, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT CAST(r.cell AS INT) AS cell, count(lab.cell) AS cnt FROM range({KC}) r(cell) LEFT JOIN lab ON lab.cell = r.cell GROUP BY 1)"
        ),
        "ivf_search_adc": with_all(IVF, first_k(LISTED.format(lut="lut"), KNN)),
        "ivf_search_sdc": with_all([*IVF, *SYMMETRIC], first_k(LISTED.format(lut="slut"), KNN)),
        "out_degree": with_all(SUPPLY, "SELECT id, count(src) AS deg FROM nodes LEFT JOIN edges ON id = src GROUP BY 1"),
        "in_degree": with_all(SUPPLY, "SELECT id, count(dst) AS deg FROM nodes LEFT JOIN edges ON id = dst GROUP BY 1"),
        "dangling": with_all(SUPPLY, "SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges)"),
        "csc_offsets": with_all(
            [*SUPPLY, ("d", "SELECT id, count(dst) AS deg FROM nodes LEFT JOIN edges ON id = dst GROUP BY 1")],
            "SELECT id, deg, CAST(coalesce(sum(deg) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d",
        ),
        "pagerank_step": ranks(TRADE, 1),
        "pagerank_sparse": ranks(SUPPLY, STEPS),
        "pagerank_single": ranks(TRADE, STEPS, single=True),
        "pagerank_opt": ranks(TRADE, STEPS, opt=True),
        "pagerank_single_opt": ranks(TRADE, STEPS, opt=True, single=True),
        "pagerank_dispatch": " UNION ALL ".join(
            f"SELECT '{way}' AS way, id, round(rank, 5) AS rank FROM ({q})"
            for way, q in (
                ("sparse single", ranks(TRADE, STEPS, single=True)), ("sparse double opt", ranks(TRADE, STEPS, opt=True)),
                ("dense double", ranks(GOOGLE, STEPS, dense=True)), ("dense double opt", ranks(GOOGLE, STEPS, opt=True, dense=True)),
            )
        ),
        "csc_arrays": with_all([*SUPPLY, *WEIGHTS], "SELECT row_number() OVER (ORDER BY dst, src) - 1 AS pos, src, dst, round(0.85 * p, 8) AS weight FROM w"),
        "ranks_text": f"SELECT id, printf('%.14g', rank) AS value FROM ({ranks(TRADE, 1)})",
        "search_front": " UNION ALL ".join(
            f"SELECT '{way}' AS way, * FROM ({q})"
            for way, q in (
                ("whole adc", with_all([*PQ, ("lut", ADC)], first_k(ADC_PAIRS, KNN))), ("whole sdc", with_all([*PQ, ("sdc", SDC)], first_k(SDC_PAIRS, KNN))),
                ("cells adc", with_all(IVF, first_k(LISTED.format(lut="lut"), KNN))), ("cells sdc", with_all([*IVF, *SYMMETRIC], first_k(LISTED.format(lut="slut"), KNN))),
            )
        ),
        "pq_columns": with_all(
            [*PQ, ("sdc", SDC), ("lut", ADC)],
            "SELECT c.vec_id, round(sum(s.dist), 6) AS sdc, round(sum(l.dist), 6) AS adc FROM codes c JOIN codes z ON z.vec_id = 0 AND z.grp = c.grp JOIN sdc s ON s.grp = c.grp AND s.c1 = z.code AND s.c2 = c.code JOIN lut l ON l.qid = 0 AND l.grp = c.grp AND l.code = c.code GROUP BY 1",
        ),
        "pair_index": "SELECT c_custkey, greatest(c_custkey % 97, c_nationkey) AS hi, least(c_custkey % 97, c_nationkey) AS lo, CAST(greatest(c_custkey % 97, c_nationkey) * (greatest(c_custkey % 97, c_nationkey) - 1) // 2 + least(c_custkey % 97, c_nationkey) AS BIGINT) AS place FROM customer",
        "vector_file": f"SELECT row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS vec_id, i AS pos, round(v, 6) AS v FROM ({LONG})",
        "graph_file": with_all(TRADE, "SELECT src, dst, count(*) AS arcs FROM edges GROUP BY 1, 2"),
        "matrix_file": with_all(GOOGLE, "SELECT i, j, round(v, 8) AS v FROM p"),
        "image_file": f"SELECT CAST(row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS INT) AS y, i AS x, round(v, 6) AS v FROM ({LONG})",
        "pagerank_converged": ranks(TRADE, 40),
        "google_matrix": with_all(GOOGLE, "SELECT i, j, round(v, 8) AS v FROM p"),
        "pagerank_dense": ranks(GOOGLE, STEPS, dense=True),
        "pagerank_dense_opt": ranks(GOOGLE, STEPS, opt=True, dense=True),
        "gemm": f"SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) AS v FROM ({WHOLE_MATRIX}) a JOIN ({WHOLE_MATRIX}) b ON a.i = b.i GROUP BY 1, 2",
        "gemm_blocked": f"SELECT * FROM (SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) AS v FROM ({WHOLE_MATRIX}) a JOIN ({WHOLE_MATRIX}) b ON a.i = b.i GROUP BY 1, 2) WHERE v <> 0",
        "matvec": f"SELECT a.i, round(sum(a.v * x.v), 6) AS y FROM ({WHOLE_MATRIX}) a JOIN ({WHOLE_MATRIX}) x ON x.i = 0 AND a.j = x.j GROUP BY 1",
        "l1_norm": "SELECT round(sum(c_acctbal), 2) AS total, round(sum(abs(c_acctbal)), 2) AS l1 FROM customer",
        "sum_squares": "SELECT round(sum(c_acctbal * c_acctbal) / 1e6, 4) AS squares FROM customer",
        "l1_diff": "SELECT round(sum(abs(c_acctbal - (c_acctbal * 2 - 1))), 2) AS l1_diff FROM customer",
        "l1_normalize": "SELECT c_custkey AS id, round(c_acctbal / (SELECT sum(abs(c_acctbal)) FROM customer), 9) AS x FROM customer",
        "vec_poly": "SELECT c_custkey, round(2 * (c_acctbal / 1000) * (c_acctbal / 1000) + 2 * (c_acctbal / 1000) / 2 - 3, 6) AS y, round(pow(c_acctbal / 1000, 3), 4) AS cube FROM customer",
        "leibniz_pi": "SELECT round(sum((CASE WHEN i % 2 = 0 THEN 4.0 ELSE -4.0 END) / CAST(2 * i + 1 AS DOUBLE)), 6) AS pi FROM range(10000000) r(i)",
    }
