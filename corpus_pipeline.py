"""A corpus from documents to pieces: each stage works on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import decontaminate, line_dedup, minmax_dedup, pieces, quality_gam
from vecloom.llm.common import free_name, load, numbered, small_batches, stash, stashed, sweep
from vecloom.llm.registry import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts: score 0.5 or more, null and empty texts too. Repeated rows are scored alike."""
    small_batches(spark)
    return quality_gam.accepted(docs, quality_gam.train(docs, load(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match earlier ones; n_chars follows, where there is such a column. Documents that lose all
    lines stay, with an empty text; a null text stays null."""
    out = line_dedup.deduplicated(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, also where ids are null or repeat: shingles of five words, similarity 0.8. The row of the least id
    stays (nulls last), of equal ids the first. Texts without words are in no group, and all stay."""
    row, own = free_name(docs, "_row"), free_name(docs, "_kept")
    rows = numbered(docs, row, "near-docs")
    kept = minmax_dedup.representatives(rows.select("doc_id", "text", F.col(row).alias("doc_row"))).withColumnRenamed("doc_row", own)
    return rows.join(kept, F.col(row) == F.col(own), "left_semi").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null texts and texts without words contain none."""
    small_batches(spark)
    return decontaminate.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text. A null or empty text has none, and decodes."""
    small_batches(spark)
    return pieces.round_trip(docs, piece_model())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", benchmark), ("pieces", encode)]

#: No SQL: the classifier is trained, and segmentation is a dynamic program over a model file.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all rows of documents: (doc_id, n_pieces, ids, same) of what is left. What a stage stashes is deleted when its
    result is written, and that when the next stage's is. An empty table gives no rows."""
    docs, kept = load(spark, sf_dir, "documents"), set(stashed())
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, kept | {docs._stash_path})
    return STAGES[-1][1](spark, docs, sf_dir)
