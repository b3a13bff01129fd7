"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of its own texts. A text is cut into pieces of PIECE bytes, each
piece is compressed with each dictionary, and the language of the least total wins; ties go to the language with more training rows.
Where the second best is within MARGIN of the best, the prediction is marked as rejected.

Dictionaries hold at most DICT_BYTES bytes a language, from about SAMPLE_DOCS texts chosen by a hash of doc_id, EXCERPT characters each
from a hashed place, of rows with text, lang and crc32(doc_id) mod 3 <> 1. Every whole text is classified. Null texts and texts without a
letter are "und" with score 0; so is everything if no language is known. Repeated rows are alike; null ids are kept and not learnt
from. Columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.quality_gam import fold

DICT_BYTES, SAMPLE_DOCS, EXCERPT = 65536, 200, 1500
PIECE, LEVEL, MARGIN = 1024, 12, 0.01
#: Bytes of difference that make a language e times as likely in the score.
SCALE = 4.0
LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, dictionary) in order of training rows, the most first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where((fold() != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_DOCS / n)))])
    h = F.xxhash64("doc_id")
    start = F.pmod(h, F.greatest(F.lit(1), F.length("text") - EXCERPT)).cast("int") + 1
    chosen = rows.where(F.pmod(h, F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)
    texts: dict[str, list] = {k: [] for k in counts}
    for r in chosen.select("lang", h.alias("h"), "doc_id", F.substring("text", start, F.lit(EXCERPT)).alias("part")).collect():  # about SAMPLE_DOCS a language
        texts[r["lang"]].append((r["h"], r["doc_id"], r["part"]))
    return [(k, "\n".join(p for _, _, p in sorted(texts[k])).encode()[-DICT_BYTES:]) for k in sorted(counts, key=lambda k: (-counts[k], k))]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        import zstandard as z

        self.langs = [k for k, _ in dictionaries]
        self.by = []
        for _, raw in dictionaries:
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
            if d:
                d.precompute_compress(level=LEVEL)
            self.by.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> np.ndarray:
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.by])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if text is None or not self.langs or not LETTER.search(text):
            return "und", 0.0, True
        s = self.sizes(text.encode())
        best = int(np.argmin(s))
        score = 1 / np.exp((s[best] - s) / SCALE).sum()
        second = np.delete(s, best).min() if len(s) > 1 else np.inf
        return self.langs[best], float(score), bool(second - s[best] < MARGIN * s[best])


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected)"""
    dictionaries = learn(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(1)]
            lang, score, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
