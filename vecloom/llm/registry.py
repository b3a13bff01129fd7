"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from vecloom.llm import avi_mjpeg, decontaminate, language_zstd, licenses, line_dedup, minmax_dedup, pieces, quality_gam, shard_tree, token_shards
from vecloom.llm.common import load

SHARDS = 16


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark, d):
    return licenses.license_hits(load(spark, d, "documents"))


def op2_minmax_dedup(spark, d):
    """Shingles of two words, similarity 0.8."""
    return minmax_dedup.near_duplicates(load(spark, d, "documents"), k=2, percent=80)


def op3_quality_gam(spark, d):
    return quality_gam.quality(load(spark, d, "documents"), load(spark, d, "labels"))


def op4_pieces(spark, d):
    return pieces.round_trip(load(spark, d, "documents"), piece_model())


def op5_language_zstd(spark, d):
    return language_zstd.languages(load(spark, d, "documents"))


def op6_line_dedup(spark, d):
    return line_dedup.line_report(load(spark, d, "documents"))


def op7_decontaminate(spark, d):
    return decontaminate.contained(load(spark, d, "documents"), load(spark, d, "benchmark"))


def op8_token_shards(spark, d):
    """The library's ids without special tokens put in; those that a text holds are matched."""
    return token_shards.token_shards(load(spark, d, "documents"), byte_tokenizer(), added=True)


def op9_avi_mjpeg(spark, d):
    """Stored forms read back; clips are the timed shots."""
    return avi_mjpeg.read_back(avi_mjpeg.stored(load(spark, d, "documents"))).withColumn("clips", avi_mjpeg.timed()).drop("cuts", "frames")


def op10_shard_tree(spark, d):
    return shard_tree.sharded(load(spark, d, "documents"), shard_tree.tree(SHARDS, base=SHARDS))


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


REGISTERED = [
    op1_license_scan, op2_minmax_dedup, op3_quality_gam, op4_pieces, op5_language_zstd, op6_line_dedup, op7_decontaminate, op8_token_shards, op9_avi_mjpeg,
    op10_shard_tree, pipeline,
]


def queries() -> dict:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.license_hits_sql(),
        "op7_decontaminate": decontaminate.contained_sql(),
        "op10_shard_tree": shard_tree.sharded_sql(shard_tree.tree(SHARDS, base=SHARDS)),
    }
