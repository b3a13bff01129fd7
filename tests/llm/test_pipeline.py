"""The pipeline against its stages composed by brute force."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from vecloom.llm import pieces, quality_gam
from vecloom.llm.registry import piece_model

from test_lines import brute as without_repeated_lines
from test_minmax import brute as groups

VOCAB = [f"w{i}" for i in range(300)]


def corpus():
    r = random.Random(11)
    say = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    item = say(30)
    shared = say(25)
    rows = []
    for d in range(90):
        lines = [say(r.randint(8, 30)) + "." for _ in range(r.randint(1, 4))]
        if d % 10 == 3:
            lines.append(shared)
        if d % 15 == 7:
            lines.append(item)
        if d % 6 == 5:
            lines = [x.upper() + "!!! $$$ ###" for x in lines]
        rows.append((d, "\n".join(lines)))
    for d in (90, 91, 92):  # near copies: one word of a long line apart, over lines that stay
        words = rows[d - 90][1].split(" ")
        words[len(words) // 2] = "other"
        rows.append((d, " ".join(words)))
    rows += [(93, ""), (94, None), (95, "one")]
    labels = [(d, int(d % 6 != 5)) for d in range(90)]
    return rows, labels, [(1, item), (2, None), (3, "")]


def test_against_composed_stages(spark, tmp_path):
    rows, labels, items = corpus()
    table = [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars int")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = quality_gam.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(d, t) for d, t in rows if model.score(quality_gam.features(pa.array([t], pa.string())))[0] >= 0.5]
    assert {d for d, _ in left if d < 90} == {d for d, q in labels if q}  # clean ones stay, the others go
    kept = without_repeated_lines(left)
    left = [(d, kept[d]) for d, _ in left]
    component = {d: c for d, _, c in groups(left, 5)}
    left = [(d, t) for d, t in left if component[d] == d]

    def shingles(t):
        w = "".join(ch if ch.isalnum() or ord(ch) > 127 else " " for ch in (t or "").lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    known = [s for _, t in items if (s := shingles(t))]
    left = [(d, t) for d, t in left if not any(100 * len(s & shingles(t)) >= 80 * len(s) for s in known)]
    codec = pieces.Codec(piece_model())
    want = {d: codec.encode(t).tolist() for d, t in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want and len(got) == len(want) and all(r.same for r in got)
    assert {3, 93, 94, 95} & set(want) and np.all([r.n_pieces == len(r.ids) for r in got])


def test_without_n_chars_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.lines(spark, docs, "").columns == docs.columns


def test_batches_for_workers_have_few_bytes(spark):
    """Batches of 10000 rows, whatever their size, took the pipeline over an executor's memory."""
    import pyarrow as pa

    from vecloom.llm.common import BATCH_BYTES, discard, stash

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    docs = spark.range(0, 4000, numPartitions=1).selectExpr("repeat('long text ', 1000) AS text")
    got = stash(docs.mapInArrow(sizes, "n long"), "batch-sizes")
    most = max(r.n for r in got.collect())
    discard(got)
    assert most < 2 * BATCH_BYTES
