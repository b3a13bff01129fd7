import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.llm import avi_mjpeg, decontaminate, language_zstd, licenses, pieces, quality_gam, shard_tree, token_shards
from vecloom.llm.registry import byte_tokenizer, piece_model

TEXTS = [
    (0, "Hello world, this is a text.\nSecond line"), (1, None), (2, ""), (3, " "), (4, "  a  \n b \n\n  c\t d  "), (5, "don't we'll  <|endoftext|> é ü   日本語 🎉 12 345,6 \x1c y"),
    (6, "x " * 3000), (7, "same"), (7, "same"), (None, "no id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"size": F.lit(1), "shard": F.lit("x"), "ids": F.lit(0.5)})


def test_token_shards(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_tokenizer())
    t.encode_special_tokens = True
    ids = [t.encode(x or "", add_special_tokens=False).ids + [0] for _, x in TEXTS]
    want = sorted((d if d is not None else -1, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(TEXTS, ids, strict=True))
    got = token_shards.token_shards(docs, byte_tokenizer()).orderBy("start").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]


def test_registered_shards_have_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from vecloom.llm.registry import op8_token_shards

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x  {end}  y\n{end}\n", f" {end}", f"{end} ", f"<|endoftext|{end}|>", f"it's{end}'s a", "<|endoftext| >", "", None, "plain  text ", " b  c", f"a{end} b  c"]
    texts += [x for _, x in TEXTS]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(byte_tokenizer())
    ids = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
    assert ids[0] == [64, 220, 50256, 275, 0]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op8_token_shards(spark, str(tmp_path)).collect()}
    assert got == {d: (len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in enumerate(ids)}


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, bound in ((0, 1), (1, 10), (1000, 1000), (1000, 10**9), (300, 20)):
        v = np.sort(r.integers(0, bound, n))
        e = token_shards.EliasFano.of(v, bound)
        again, _ = token_shards.EliasFano.read(memoryview(e.to_bytes()), 0)
        assert again.all().tolist() == v.tolist() == [again.select(i) for i in range(n)]


def best_score(c, s):
    best = [0.0] + [-math.inf] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - 20), e):
            i = c.lookup.get(s[b:e])
            score = c.scores[i] if i is not None else c.floor if b == e - 1 else -math.inf
            best[e] = max(best[e], best[b] + score)
    return best[-1]


def test_pieces(docs):
    c = pieces.Codec(piece_model())
    c.lookup = {c.pieces[i]: i for i in c.scores}
    for w in ["▁the", "▁thhesanwh,", "▁日本語x", "▁élan🎉", "▁▁▁a", "▁\tq\n"]:
        known = sum(c.scores[i] for i in c.viterbi(w) if i in c.scores)
        unknown = sum(1 for ch in w if ch not in c.single)
        assert math.isclose(known + unknown * c.floor, best_score(c, w))
    got = pieces.round_trip(docs, piece_model()).collect()
    assert all(r.same for r in got) and sum(r.n_pieces == 0 for r in got) == 2


def test_avi(docs):
    got = avi_mjpeg.read_back(avi_mjpeg.stored(docs)).collect()
    for (_, t), r in zip(sorted(TEXTS, key=str), sorted(got, key=lambda r: str((r.doc_id, dict(TEXTS).get(r.doc_id)))), strict=True):
        raw = avi_mjpeg.payload((t or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
    raw = bytes(range(256)) * 9
    media = avi_mjpeg.encode(raw)
    frames = avi_mjpeg.frames_of(media)
    slow = np.array([avi_mjpeg.coefficients(f) for f in frames])
    slow[:, 1:, 0] = np.diff(slow[:, :, 0])
    assert (np.abs(slow) - 256).astype(np.uint8).tobytes() == raw == avi_mjpeg.units(frames).tobytes()
    shots = np.array([[10] * 576] * 12 + [[200] * 576] * 12, np.uint8)
    assert avi_mjpeg.cuts(shots).tolist() == [12]
    assert avi_mjpeg.clips(avi_mjpeg.read_back(avi_mjpeg.stored(docs))).where("doc_id = 0").count() == 1


def test_decontaminate(spark, docs):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "a b c " * 50 + item.upper() + " d e"), (2, " ".join(item.split()[:28])), (3, " ".join(item.split()[:20])), (4, None), (5, "two words")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.found) for r in decontaminate.contained(d, items).collect()}
    assert got == {(1, 7): (26, 26), (2, 7): (26, 24), (5, None): (1, 1)}
    assert [r.doc_id for r in decontaminate.decontaminated(d, items).collect()] == [3, 4]
    assert decontaminate.decontaminated(d, items.limit(0)).count() == 5


def test_shards(docs, spark):
    got = shard_tree.sharded(docs, shard_tree.tree(16)).collect()
    assert len(got) == len(TEXTS)
    many = shard_tree.sharded(spark.range(4000).selectExpr("id AS doc_id", "string(id) AS text"), shard_tree.tree(16)).collect()
    for s in range(16):
        slots = sorted(r.slot for r in many if r.shard == s)
        assert slots == list(range(len(slots))) and 150 < len(slots) < 350
    assert all(r.grown_shard in (r.shard, 16) for r in many) and {r.grown_shard for r in many} == set(range(17))
    before = shard_tree.place(spark.range(3000), shard_tree.tree(16), F.col("id").cast("string"), "a")
    both = shard_tree.place(before, shard_tree.tree(16, weights={3: 4.0}), F.col("id").cast("string"), "b").collect()
    assert all(r.a == r.b or r.b // 8 == 0 for r in both)  # rows move into the subtree whose weight rose, or within it
    assert shard_tree.sharded(docs.limit(0), shard_tree.tree(16)).count() == 0


def test_licenses(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ;")), (2, "some text\n// Released under the MIT Licence!\nmore"), (3, "released under the mit license"),
        (4, None), (5, ""), (6, "Copyright 2020 X"), (7, mit + " extra"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    got = sorted((r.doc_id, r.line_no, r.license_id) for r in licenses.license_hits(d).collect())
    assert got == [(1, None, "MIT"), (2, 1, "MIT"), (3, None, "MIT")]


def test_quality(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(rng.choice(words, 30)).upper() + "!!" if i % 4 == 0 else " ".join(rng.choice(words, 30)) + ".") for i in range(300)]
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_gam.quality(d, labels).collect()}
    assert all(r.predicted == int(i % 4 != 0) for i, r in got.items() if i < 900 and r.held_out) and len(got) == 302
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    none = quality_gam.quality(d, labels.limit(0)).first()
    assert none.score == 0.5
    assert quality_gam.features(pa.array(["", None])).shape == (2, len(quality_gam.NAMES))


def test_languages(spark):
    rng = np.random.default_rng(1)
    stems = {"aa": ["thor", "wen", "hald"], "bb": ["éla", "oui", "dré"]}
    rows = [(i, " ".join("".join(rng.choice(stems[k], 2)) for _ in range(40)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    d = spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 !?", None)], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    got = {r.doc_id: r for r in language_zstd.languages(d).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows if got[i].held_out)
    assert got[500].lang_pred == got[501].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_zstd.languages(d.where("lang IS NULL")).collect()} == {"und"}

def test_more_licences(spark):
    texts = {
        "BSD-3-Clause": "Copyright Jane Doe\nAll rights reserved.\n\n" + licenses._bsd(3)[1].replace("\n\n", "\n * "), "BSD-2-Clause": "Copyright (c) 1999, X\n" + licenses._bsd(2)[2], "Unlicense": licenses._UNLICENSE.format("https", "/"),
        "Apache-2.0": "Copyright Example Corp. 2020\n\n" + "\n".join("# " + x for x in licenses._APACHE_NOTICE.format("http").split(". ")), "MIT": "Copyright by Jane Doe\n" + licenses._MIT_BODY, "Zlib": licenses._ZLIB, "BSL-1.0": licenses._BOOST,
        "LGPL-2.1-or-later": licenses._GNU_NOTICE.format(work="library", name="Lesser General Public License", version="2.1", web="https"),
    }
    rows = [(i, t) for i, t in enumerate(texts.values())] + [(90, "Copyright holders be liable for any claim"), (91, "released under the licence licence licence"), (92, None)]
    got = {(r.doc_id, r.license_id) for r in licenses.license_hits(spark.createDataFrame(rows, "doc_id long, text string")).where("line_no IS NULL").collect()}
    assert got == set(enumerate(texts))
    forms = licenses.units(spark.createDataFrame([(1, "the licence licence licence"), (2, "copyright holders be liable for any claim"), (3, "Copyright Jane Doe\nx")], "doc_id long, text string"), "doc_id").collect()
    assert {(r.doc_id, r.form) for r in forms} == {(1, "the license license license"), (2, "copyright holders be liable for any claim"), (3, "x")}
