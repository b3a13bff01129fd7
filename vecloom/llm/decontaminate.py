"""Benchmark decontamination: size-partitioned MinHash containment search.

Benchmark items are short and documents long, so the Jaccard similarity of the two is near 0 and plain MinHash bands are blind. What
is asked for is containment: the share of an item's shingles that a document has. An item's MinHash sketch is its bottom-k
sample, the k shingles of least hash. Items are partitioned by size (powers of two); a partition's k is one more than the number of
shingles that its largest item may miss, so that a document that contains the share has at least one sampled shingle of the item:
the search has no false negatives. Documents too small for a partition skip it. Candidates are verified on full shingle sets.

Items go to the tasks in blocks of at most BLOCK_SHINGLES shingles; a larger benchmark takes more passes. Documents are not shuffled.

Words are runs of ASCII letters (lower-cased) and digits and of all other than ASCII characters. A text of fewer words than a
shingle has its whole sequence as one. Nulls and texts without words contain nothing and are contained in nothing. Repeated
documents and items give repeated rows; null ids are kept. Columns besides those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import Words, shingles, slices, text_bytes, trim

#: Everything in ASCII but letters and digits parts words.
PLAIN_WORDS = Words(bytes(b for b in range(128) if not chr(b).isalnum()))
BLOCK_SHINGLES = 1 << 21
SCHEMA = "doc_id long, item_id long, item_shingles long, found long"


def needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


class Block:
    """Sketches and full sets of some items."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], k: int, percent: int):
        self.k, self.percent = k, percent
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        samples, owners = [], []
        for at, s in enumerate(self.sets):
            largest = (1 << len(s).bit_length()) - 1
            k_part = largest - needed(largest, percent) + 1
            samples.append(s[:k_part])  # sets are sorted by hash
            owners.append(np.full(len(samples[-1]), at))
        keys = np.concatenate([*samples, np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], np.concatenate([*owners, np.zeros(0, np.int64)])[order]
        self.top = np.zeros(1 << 16, bool)
        self.top[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.least = min((needed(len(s), percent) for s in self.sets), default=0)

    def hits(self, text: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, found) of all rows that contain an item."""
        s, at = shingles(*PLAIN_WORDS.hashes(*text_bytes(text)), self.k)
        maybe = np.flatnonzero(self.top[(s >> np.uint64(48)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.keys, s[maybe], side=x) for x in ("left", "right"))
        rows = np.searchsorted(at, maybe, side="right") - 1
        pairs = {(int(r), int(o)) for r, a, b in zip(rows[hi > lo], lo[hi > lo], hi[hi > lo], strict=True) for o in self.owners[a:b]}
        own: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))
        for r, o in sorted(pairs):
            n, size = len(self.sets[o]), at[r + 1] - at[r]
            if size < needed(n, self.percent):
                continue
            if own[0] != r:
                own = (r, np.unique(s[at[r] : at[r + 1]]))
            found = len(np.intersect1d(own[1], self.sets[o], assume_unique=True))
            if found >= needed(n, self.percent):
                yield r, o, found


def blocks(items: DataFrame, k: int, percent: int) -> Iterator[Block]:
    """The items (item_id, text) with shingles, in blocks."""
    held, size = [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        s, _ = shingles(*PLAIN_WORDS.hashes(*text_bytes(pa.array([text], pa.string()))), k)
        s = np.unique(s)
        if not len(s):
            continue
        if held and size + len(s) > BLOCK_SHINGLES:
            yield Block(held, k, percent)
            held, size = [], 0
        held.append((item_id, s))
        size += len(s)
    if held:
        yield Block(held, k, percent)


def contained(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, item_shingles, found): a row for each item of which a document has percent / 100 of the shingles."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in blocks(items, k, percent):

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, text = batch.columns
                found = []
                for a, b in slices(text):
                    found += [(ids[a + r].as_py(), block.ids[o], len(block.sets[o]), n) for r, o, n in block.hits(text.slice(a, b - a))]
                cols = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "item_shingles", "found"])

        out = out.union(source.mapInArrow(scan, SCHEMA))
    return out


def decontaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that contain no item. One pass, no join."""
    at = docs.columns.index("text")
    for block in blocks(items, k, percent):

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(at)):
                    part = batch.slice(a, b - a)
                    clean = np.ones(b - a, bool)
                    for r, _, _ in block.hits(part.column(at)):
                        clean[r] = False
                    yield part.filter(pa.array(clean))
            trim()

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


#: DuckDB SQL of the word list and the shingle list of a text column.
SQL_WORDS = "regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+')"
SQL_SHINGLES = "list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"


def contained_sql(k: int = 5, percent: int = 80, docs: str = "documents", items: str = "benchmark") -> str:
    def sets(table: str, key: str) -> str:
        return f"SELECT {key}, unnest({SQL_SHINGLES.format(k=k)}) AS s FROM (SELECT {key}, {SQL_WORDS.format(t='text')} AS w FROM {table})"

    return f"""WITH i AS ({sets(items, "item_id")}), n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY 1), d AS ({sets(docs, "doc_id")}),
f AS (SELECT doc_id, item_id, count(*) AS found FROM d JOIN i ON d.s = i.s GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, found FROM f JOIN n USING (item_id) WHERE 100 * found >= {percent} * item_shingles"""
