"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bagminhash,
    bpe,
    decontaminate,
    divergence,
    hmm,
    html_extract,
    merkle,
    pu_quality,
    quality_rules,
    secrets,
    shards,
    surrogates,
    warc,
)
from .common import fresh_path, read_table


#: Keys of the queries; a deployment passes secrets of its own.
ORDER_KEY, SURROGATE_KEY = "training-order-1", "surrogates-1"


def byte_vocabulary() -> tuple[str, str]:
    """Path and pattern of the byte-level vocabulary used by the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def owner_and_repository() -> tuple[Column, Column]:
    """Who holds a text: its source, and the source's part in one language."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), *byte_vocabulary(), digests=True)


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = shards.materialise(read_table(spark, sf_dir, "documents"), fresh_path(spark, "shards"), ORDER_KEY, *byte_vocabulary())
    return shards.read_slots(spark, layout, content=False)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.replace(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return replaced.select("doc_id", "text", F.col("__entities").alias("n_entities"), F.array_join("__kinds", ",").alias("kinds"))


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = bagminhash.classes(read_table(spark, sf_dir, "documents"))
    return placed.select(F.col("__id").alias("doc_id"), "class_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("broken_rules", ",").alias("broken_rules"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return judged.select(
        F.col("__id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(read_table(spark, sf_dir, "documents"), *owner_and_repository())


def op10_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_level_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.audit(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("grp").alias("lang"), F.col("part").alias("source"), F.col("kind").alias("part"), "item", "value", "rank")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    # every seventh row by checksum is checked with one more in n_chars; a
    # decimal, because the largest long has no successor
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    altered = F.when(chosen, merkle.leaf_of([*fields[:3], one_more, fields[4]]))
    tree = merkle.manifest(merkle.leaves(docs, "doc_id", "lang", fields, altered))
    return tree.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return hmm.score(read_table(spark, sf_dir, "documents"), held_out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_pu_quality": op3_pu_quality,
    "op4_training_order": op4_training_order,
    "op5_surrogates": op5_surrogates,
    "op6_bagminhash": op6_bagminhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_host_paths": op10_host_paths,
    "op11_level_products": op11_level_products,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hidden_markov": op13_hidden_markov,
}
