import random

from pyspark.sql import functions as F

from vecloom.llm.components import components
from vecloom.llm.minmax_dedup import near_duplicates


def words(text):
    return (text or "").encode().lower().split()


def sets_of(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 30)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append((len(rows), r.choice([" ", "\n", "\t"]).join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "one"), (1004, "ONE"), (1005, "é"), (1006, "É"), (1006, "É"), (1007, "x " * 5000)]
    r.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "cid": F.lit("x")})
    for k in (2, 5):
        got = near_duplicates(docs, k).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_null_ids_and_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 2).collect() == []
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, "z y")], "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.component_id) == [(0, 7, False), (7, 7, True)]


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}


def test_pipeline_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    long = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, long("a")), (1, long("a")), (1, long("b")), (None, long("c")), (None, long("c")), (None, long("d")), (2, long("d")), (3, ""), (3, ""), (4, None)]
    want = [(1, long("a")), (1, long("b")), (None, long("c")), (2, long("d")), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x"))
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)
