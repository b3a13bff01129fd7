import random
import re

from pyspark.sql import functions as F

from vecloom.llm.line_dedup import deduplicated, line_report


def brute(rows):
    lines = [(d, i, set(w for w in re.split("[ \\t\\x0b\\f\\r]+", x.lower()) if w)) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: (x[0] is not None, x[0], x[1]))
    gone = set()
    for j, (d, i, s) in enumerate(lines):
        if s and any(len(s & e) * 5 >= len(s | e) * 4 and (d0, i0) != (d, i) for d0, i0, e in lines[:j] if e):
            gone.add((d, i))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def corpus():
    r = random.Random(5)
    vocab = [f"V{i}" for i in range(150)] + ["the", "of"] * 20
    bases = [[r.choice(vocab) for _ in range(r.randint(1, 40))] for _ in range(25)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab).upper()
            text.append(r.choice([" ", "\t", "  "]).join(w))
        rows.append((d, "\n".join(text)))
    return rows + [(100, None), (101, ""), (102, "\n \n\n"), (103, "é É\nÉ é\né"), (104, "w " * 3000), (-1, "the of")]


def test_against_all_pairs(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone": F.lit(3), "n_chars": F.lit(1)})
    want = brute(rows)
    from vecloom.llm import line_dedup

    for hot in (10, 2):  # with few and with many pair keys
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = {r.doc_id: r.text for r in line_report(docs).collect()}
        assert {d: (got[d], t) for d, t in want.items() if got[d] != t} == {}
    out = deduplicated(docs)
    assert out.columns == docs.columns


def test_empty(spark):
    assert line_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_of_one_id(spark, tmp_path):
    rows = [(None, "x y z\nu1"), (None, "u2\nx y z"), (None, None), (7, "a b\nc d"), (7, "a b\ne f"), (7, "g h"), (8, "p q"), (8, "p q")]
    want = [(None, "x y z\nu1"), (None, "u2"), (None, None), (7, "a b\nc d"), (7, "e f"), (7, "g h"), (8, "p q"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/docs")
    for d in (docs, spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/docs").where("true")):
        for out in (line_report(d), deduplicated(d)):
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_one_file_read_twice(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, "e f")], "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/docs")
    got = line_report(spark.read.parquet(f"{tmp_path}/docs", f"{tmp_path}/docs")).collect()
    assert sorted((r.doc_id, r.n_removed, r.text) for r in got) == [(1, 0, "a b\nc d"), (1, 2, ""), (2, 0, "e f"), (2, 1, "")]


def test_words_with_one_key(spark):
    import numpy as np

    from vecloom.llm.common import BLANK_WORDS
    from vecloom.llm.line_dedup import HASH_BITS

    size = 7
    raw = np.frombuffer("".join(f"{i:0{size}d}" for i in range(3_000_000)).encode(), np.uint8)
    h, _ = BLANK_WORDS.hashes(raw, np.arange(0, len(raw) + 1, size))
    top = h >> np.uint64(64 - HASH_BITS)
    order = np.argsort(top)
    x = int(np.flatnonzero(top[order[1:]] == top[order[:-1]])[0])
    a, b = (f"{i:0{size}d}" for i in order[x : x + 2])
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, f"{a} k l m n"), (6, f"{b} k l m n")]
    got = {r.doc_id: r.text for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == dict(rows) | {4: ""}
