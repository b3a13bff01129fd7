"""Empty tables, very long texts, growth of shards, and recomputed results of the trained operators."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from vecloom.llm import avi_mjpeg, decontaminate, language_zstd, licenses, line_dedup, pieces, quality_gam, shard_tree, token_shards
from vecloom.llm.registry import byte_tokenizer, piece_model


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, extra int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        licenses.license_hits(none), quality_gam.quality(none, labels), pieces.round_trip(none, piece_model()), language_zstd.languages(none), token_shards.token_shards(none, byte_tokenizer()),
        avi_mjpeg.read_back(avi_mjpeg.stored(none)), decontaminate.contained(none, items), shard_tree.sharded(none, shard_tree.tree(3)), line_dedup.deduplicated(none),
    ):
        assert out.count() == 0


def test_growth_moves_rows_into_the_new_shard_alone(spark):
    rows = spark.range(400)
    key = F.col("id").cast("string")
    for base in (0, 8, 16):
        for n in range(max(base, 1), 41):
            assert shard_tree.grow(shard_tree.tree(n, base)) == shard_tree.tree(n + 1, base)
    for n, base in ((1, 0), (7, 0), (8, 0), (8, 8), (15, 8), (23, 16), (24, 0), (40, 16)):
        both = shard_tree.place(shard_tree.place(rows, shard_tree.tree(n, base), key, "a"), shard_tree.tree(n + 1, base), key, "b").collect()
        assert all(r.b in (r.a, n) for r in both) and any(r.b == n for r in both)
    with pytest.raises(ValueError):
        shard_tree.tree(7, 8)


def test_long_texts(spark):
    """Linear in the lines: a text of 200,000 lines takes seconds."""
    lines = [f"line number {i} of a long text" if i % 2 else "the same words again and again" for i in range(60_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "Released under the MIT License.\n" + "\n" * 100_000 + "x"), (3, "w" * 3_000_000)], "doc_id long, text string")
    began = time.time()
    hits = licenses.license_hits(docs).collect()
    assert [(r.doc_id, r.line_no, r.license_id) for r in hits] == [(2, 0, "MIT")]
    assert time.time() - began < 60
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.line_report(docs.where("doc_id < 3")).collect()}
    assert got[1].n_lines == 60_000 and got[1].text.split("\n").count("the same words again and again") == 1
    assert got[2].n_removed == 0 and got[2].text.count("\n") == 100_001
    assert time.time() - began < 120
    assert all(r.same for r in pieces.round_trip(docs, piece_model()).collect())


def test_near_copies_of_lines(spark, monkeypatch):
    """A large group of near copies, with bounds so small that keys are hot and crowded."""
    from test_lines import brute

    r = random.Random(8)
    base = [f"word{i}" for i in range(30)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5])):
            w[r.randrange(30)] = r.choice(["alpha", "beta", f"own{d}"])
        rows.append((d, " ".join(w) + "\nnot like the others " + " ".join(f"x{r.randrange(60)}" for _ in range(6))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for hot, crowd, lead in ((4, 8, 4), (12, 16, 4)):
        for name, value in (("HOT", hot), ("CROWD", crowd), ("LEAD", lead)):
            monkeypatch.setattr(line_dedup, name, value)
        got = {x.doc_id: x.text for x in line_dedup.line_report(docs).collect()}
        assert {d: (got[d], t) for d, t in want.items() if got[d] != t} == {}


def plain_ids(c, text):
    """Every piece tried at every end of the whole text, the longest first."""
    s = pieces.SPACE + text.replace(" ", pieces.SPACE)
    longest = max(map(len, c.lookup))
    best, back = [0.0], [None]
    for e in range(1, len(s) + 1):
        top, how = -np.inf, None
        for b in range(max(0, e - longest), e):
            i = c.lookup.get(s[b:e])
            if i is not None and best[b] + c.scores[i] > top:
                top, how = best[b] + c.scores[i], (b, i)
        if s[e - 1] not in c.single and best[e - 1] + c.floor > top:
            top, how = best[e - 1] + c.floor, (e - 1, None)
        best.append(top)
        back.append(how)
    out, e = [], len(s)
    while e:
        b, i = back[e]
        out += [i] if i is not None else [c.bytes[x] for x in reversed(s[b:e].encode())]
        e = b
    return out[::-1]


def test_pieces_of_whole_texts(spark):
    c = pieces.Codec(piece_model())
    c.lookup = {c.pieces[i]: i for i in c.scores}
    r = random.Random(2)
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(25).collect()]
    odd = "abc  é日本🎉\t\n▁.,XYZ　\u0000ß"
    texts = [t[:1500] for t in texts if t] + ["".join(r.choice(odd) for _ in range(r.randint(1, 60))) for _ in range(60)] + ["x" * 700, "日本" * 200, " ", "   ", "a "]
    flat, counts, _, _ = c.encode_all(pa.array([None, *texts, ""]))
    got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [[], *(plain_ids(c, t) for t in texts), []]
    assert [c.decode(x) for x in got[1:-1]] == [pieces.normalized(t) for t in texts]
    assert [c._long((pieces.SPACE + "日本x").replace(pieces.SPACE, " ").encode())] == [plain_ids(c, "日本x")]


def test_scores_are_sums_of_table_entries(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(500, 4)), rng.integers(0, 2, 500).astype(float)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float) * 0.9 + y * 0.1
    m = quality_gam.fit(x, (y > 0.5).astype(float))
    got = m.score(x[:50])
    for row, score in zip(x, got, strict=False):
        z = m.bias
        for j, (edges, table) in enumerate(zip(m.edges, m.tables, strict=True)):
            z += table[sum(row[j] >= e for e in edges)]
        for (i, j), table in m.pairs.items():
            z += table[sum(row[i] >= e for e in m.coarse[i]), sum(row[j] >= e for e in m.coarse[j])]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-12
    assert m.pairs and ((m.score(x) >= 0.5) == (y > 0.5)).mean() > 0.9


def test_languages_by_plain_sizes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = language_zstd.learn(docs)
    got = {r.doc_id: r.lang_pred for r in language_zstd.languages(docs).collect()}
    tools = []
    for lang, raw in known:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tools.append((lang, zstandard.ZstdCompressor(level=language_zstd.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    for r in docs.collect():
        if r.text is None or not any(ch.isalpha() for ch in r.text):
            assert got[r.doc_id] == "und"
            continue
        raw = r.text.encode()
        sizes = [sum(len(t.compress(raw[i : i + language_zstd.PIECE])) for i in range(0, len(raw), language_zstd.PIECE)) for _, t in tools]
        assert got[r.doc_id] == known[sizes.index(min(sizes))][0]  # ties: the language of more rows
    held = [(got[r.doc_id], r.lang) for r in docs.where(quality_gam.fold() == 1).collect() if r.lang and r.text]
    assert np.mean([a == b for a, b in held]) > 0.9
