"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bloom_fingerprint,
    chunked_bpe,
    decontamination,
    filter_audit,
    hilbert_shards,
    line_dedup,
    mixture_packing,
    multi_index_hashing,
    ngram_join,
    pii_bootstrap,
    quality_gam,
    ranked_search,
    suffix_dedup,
)
from .common import table


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.report(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_removed", F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed")
    )


def op5_bloom_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.report(table(spark, sf_dir, "documents"))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_hashing.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = chunked_bpe.decode(chunked_bpe.encode(table(spark, sf_dir, "documents")))
    return there.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "set_id", "class_id", "n_links")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


QUERIES = {
    f.__name__: f
    for f in (op1_hilbert_shards, op2_quality_gam, op3_suffix_dedup, op4_line_dedup, op5_bloom_fingerprint, op6_pii_bootstrap, op7_mixture_packing, op8_multi_index_hashing, op9_chunked_bpe, op10_ngram_join, op11_ranked_search, op12_filter_audit, op13_decontamination)
}
ORACLES: dict[str, str] = {"op4_line_dedup": line_dedup.SQL_REPORT, "op11_ranked_search": ranked_search.SQL, "op12_filter_audit": filter_audit.SQL, "op13_decontamination": decontamination.SQL}
