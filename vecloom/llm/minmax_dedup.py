"""Near-duplicate search with min-max hashing.

A text's set is its distinct word shingles (64-bit hashes). Under each of PERMUTATIONS random permutations both the least and the
greatest hash are kept, so BANDS x ROWS signature values cost half as many hash evaluations. ROWS values of different
permutations make a band; texts that agree in a band are candidates. At similarity 0.8 a pair shares no band with probability
(1 - 0.8^4)^32 < 1e-7.

1. Texts of one set are one class (a group-by of 16-byte digests), so exact copies cost one row each.
2. In each band bucket all classes are compared with its least member only (a star), on full sets.
3. Stars that hold members of several components are then compared in full, outsiders against members, in blocks of at most
   BLOCK rows a side; only links leave a task. This is what makes the result complete: no bucket is capped.
4. Components of the links give the ids.

Nulls: a null text is an empty text; empty texts have no set and link with nothing. Repeated rows are copies. A null doc_id links
like others, and does not count as least. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import BLANK_WORDS, STEP, discard, mix, shingles, slices, stash, text_bytes, trim
from vecloom.llm.components import components

BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS // 2
#: Most members on each side of a block, and about the most shingles.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
_SEED = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
FACTOR, SHIFT = _SEED[:PERMUTATIONS] | np.uint64(1), _SEED[PERMUTATIONS:]


def digest(unique: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    a, b = mix(unique), mix(unique ^ np.uint64(STEP))
    return np.array([a.sum(), b.sum()], np.uint64).tobytes()


def bands(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, BANDS) band hashes of the sets s[first[i]:first[i + 1]], none of them empty."""
    low, high = (np.empty((PERMUTATIONS, len(first) - 1), np.uint64) for _ in range(2))
    for p in range(PERMUTATIONS):
        v = s * FACTOR[p] + SHIFT[p]
        low[p], high[p] = np.minimum.reduceat(v, first[:-1]), np.maximum.reduceat(v, first[:-1])
    out = np.empty((len(first) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(first) - 1, b, np.uint64)
        for v in (low[2 * b], low[2 * b + 1], high[(2 * b + 2) % PERMUTATIONS], high[(2 * b + 3) % PERMUTATIONS]):
            x = mix(x * np.uint64(STEP) + v)
        out[:, b] = x
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, cid, bands): size and digest of each set, and its band hashes (none for an empty set); and doc_row if docs has it."""
    rows = [c for c in docs.columns if c == "doc_row"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text, *numbers = batch.columns
            for a, b in slices(text):
                s, at = shingles(*BLANK_WORDS.hashes(*text_bytes(text.slice(a, b - a))), k)
                sets = [np.unique(s[at[i] : at[i + 1]]) for i in range(b - a)]
                some = [i for i, u in enumerate(sets) if len(u)]
                flat = [None] * (b - a)
                if some:
                    joined = np.concatenate([sets[i] for i in some])
                    first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])])
                    for i, row in zip(some, bands(joined, first).view(np.int64), strict=True):
                        flat[i] = row
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(u) for u in sets], pa.int64()), pa.array([digest(u) if len(u) else None for u in sets], pa.binary()), pa.array(flat, pa.list_(pa.int64())), *(x.slice(a, b - a) for x in numbers)],
                    ["doc_id", "n", "cid", "bands", *rows],
                )
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rows).mapInArrow(scan, ", ".join(["doc_id long, n long, cid binary, bands array<long>", *(f"{c} long" for c in rows)]))


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rid, shingles) of the classes in wanted (rid, min_doc, cid), from their first documents' texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, rid, cid = batch.columns
            for a, b in slices(text):
                s, at = shingles(*BLANK_WORDS.hashes(*text_bytes(text.slice(a, b - a))), k)
                sets = [np.unique(s[at[i] : at[i + 1]]) for i in range(b - a)]
                own = [i for i in range(b - a) if digest(sets[i]) == cid[a + i].as_py()]  # of repeated ids, the right text
                yield pa.RecordBatch.from_arrays(
                    [rid.slice(a, b - a).take(pa.array(own, pa.int64())), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], ["rid", "shingles"]
                )
        trim()

    # without ids that are null, but for classes that have no other
    texts = docs.select(F.col("doc_id").cast("long").alias("min_doc"), "text")
    joined = texts.join(wanted, texts.min_doc.eqNullSafe(wanted.min_doc))
    return joined.select("text", "rid", "cid").mapInArrow(scan, "rid long, shingles array<long>")


def similar(inter, n, m, percent: int):
    return 100 * inter >= percent * (n + m - inter)


def block_links(percent: int):
    """Kernel of step 3: links of outsiders with members of other components, one for each component."""

    def links(key: tuple, t: pa.Table) -> pa.Table:
        side = t["outsider"].to_numpy(zero_copy_only=False).astype(bool)
        rid, comp = t["rid"].to_numpy(), t["comp"].to_numpy()
        sets = [np.asarray(x.values).view(np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in t["shingles"]]
        out, mem = np.flatnonzero(side), np.flatnonzero(~side)
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(out) or not len(mem):
            return none
        n = np.array([len(s) for s in sets])
        both = np.intersect1d(np.concatenate([sets[i] for i in out]), np.concatenate([sets[i] for i in mem]))
        at = [np.searchsorted(both, s) for s in sets]
        at = [p[(p < len(both))][both[p[p < len(both)]] == s[p < len(both)]] for p, s in zip(at, sets, strict=True)]
        inter = np.zeros((len(out), len(mem)), np.float32)
        for c in range(0, len(both), 4096):  # columns at once
            x, y = np.zeros((len(out), 4096), np.float32), np.zeros((len(mem), 4096), np.float32)
            for m, rows in ((x, out), (y, mem)):
                for r, i in enumerate(rows):
                    lo, hi = np.searchsorted(at[i], (c, c + 4096))
                    m[r, at[i][lo:hi] - c] = 1
            inter += x @ y.T
        inter = inter.astype(np.int64)
        ok = similar(inter, n[out][:, None], n[mem][None, :], percent) & (comp[out][:, None] != comp[mem][None, :])
        o, m = np.nonzero(ok)
        if not len(o):
            return none
        _, once = np.unique(np.stack([o, comp[mem][m]]), axis=1, return_index=True)
        return pa.table({"a": rid[out][o[once]], "b": rid[mem][m[once]]})

    return links


def _labels(pairs: DataFrame, col: str, labels: DataFrame, out: str) -> DataFrame:
    own = labels.select(F.col("node").alias(col), F.col("root").alias(out))
    return pairs.join(own, col, "left").withColumn(out, F.coalesce(out, col))


def _grouped(docs: DataFrame, k: int, percent: int, *more: str) -> DataFrame:
    """(doc_id, n_shingles, cid, component_id, more) of each row of docs; of more, doc_row is a column of docs and root names the group."""
    s = stash(signed(docs, k), "mm-signed")
    grouped = s.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("min_doc"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stash(grouped.withColumn("rid", F.monotonically_increasing_id()), "mm-classes")
    rows = classes.select("rid", "n", F.explode("bands").alias("bucket"))
    least = F.min(F.struct("rid", "n")).alias("c")
    buckets = stash(rows.groupBy("bucket").agg(least, F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", F.col("c.rid").alias("centre"), F.col("c.n").alias("cn")), "mm-buckets")
    met = rows.join(buckets, "bucket").where("rid <> centre")
    stars = stash(met.select("centre", "cn", "rid", "n").distinct(), "mm-stars")
    discard(buckets)
    labels = _component_labels(docs, classes, stars, k, percent)
    named = classes.select("cid", "rid", "min_doc")
    named = _labels(named, "rid", labels, "root")
    roots = stash(named.groupBy("root").agg(F.min("min_doc").alias("component_id")), "mm-roots")
    ids = stash(named.join(roots, "root").select("cid", "component_id", *(c for c in more if c == "root")), "mm-ids")
    return s.select("doc_id", F.col("n").alias("n_shingles"), "cid", *(c for c in more if c != "root")).join(ids, "cid", "left")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text): the size of its set of k-word shingles, the
    least doc_id that links of percent / 100 Jaccard or more reach, and whether that is its own."""
    out = _grouped(docs, k, percent)
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_row) of docs (doc_id, text, doc_row): one row of each group, the first of its least id, and every row without shingles."""
    out = _grouped(docs, k, percent, "doc_row", "root")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_row")).alias("c")
    return out.where("n_shingles > 0").groupBy("root").agg(least).select("c.doc_row").union(out.where("n_shingles = 0").select("doc_row"))


def _component_labels(docs: DataFrame, classes: DataFrame, stars: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of the classes that have links."""
    members = stars.select("rid").union(stars.select("centre")).distinct()
    sets = stash(full_sets(docs, members.join(classes.select("rid", "min_doc", "cid"), "rid"), k), "mm-sets")
    fit = stars.where((F.col("n") * 100 >= F.col("cn") * percent) & (F.col("cn") * 100 >= F.col("n") * percent))
    centre = sets.select(F.col("rid").alias("centre"), F.col("shingles").alias("other"))
    inter = F.size(F.array_intersect("shingles", "other"))
    direct = fit.join(sets, "rid").join(centre, "centre").where(similar(inter, F.col("n"), F.col("cn"), percent))
    links = stash(direct.select(F.col("rid").alias("a"), F.col("centre").alias("b")), "mm-links")
    labels = stash(components(links), "mm-labels")
    marked = _labels(_labels(stars.select("centre", "rid", "n"), "rid", labels, "comp"), "centre", labels, "centre_comp")
    marked = marked.withColumn("outsider", F.col("comp") != F.col("centre_comp"))
    out = F.col("outsider").cast("long")
    blocks = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    per_star = marked.groupBy("centre").agg(F.count(F.lit(1)).alias("rows"), F.sum(out).alias("outsiders"), F.sum("n").alias("size"), F.sum(out * F.col("n")).alias("out_size"))
    per_star = per_star.where("outsiders > 0 AND rows > 1").select("centre", blocks(F.col("rows"), F.col("size")).alias("mem_blocks"), blocks(F.col("outsiders"), F.col("out_size")).alias("out_blocks"))
    open_rows = stash(marked.join(stash(per_star, "mm-open"), "centre").select("centre", "rid", "comp", "outsider", "mem_blocks", "out_blocks"), "mm-marked")
    if open_rows.isEmpty():
        return labels
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    left = open_rows.where("outsider").select("centre", all_of("mem_blocks").alias("mb"), one_of("out_blocks").alias("ob"), "rid", "comp", F.lit(True).alias("outsider"))
    right = open_rows.select("centre", one_of("mem_blocks").alias("mb"), all_of("out_blocks").alias("ob"), "rid", "comp", F.lit(False).alias("outsider"))
    placed = left.union(right).join(sets, "rid")
    more = stash(placed.groupBy("centre", "mb", "ob").applyInArrow(block_links(percent), "a long, b long"), "mm-more")
    if more.isEmpty():
        return labels
    return stash(components(links.union(more)), "mm-labels")
