"""Corpus pipeline over the ``documents`` table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and hands the reread table to the
next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm import bagminhash, bpe, decontaminate, quality_rules, secrets
from delaylens.llm.common import read_table, stage
from delaylens.llm.queries import byte_vocabulary, owner_and_repository


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id."""
    return bagminhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific credentials masked; ``n_chars``
    follows the text."""
    return secrets.mask_live(docs, *owner_and_repository()).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as token ids, with digests of ids and text."""
    return bpe.encode_documents(docs, *byte_vocabulary(), digests=True)


STAGES = [
    ("quality_rules", quality),
    ("bagminhash", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("byte_bpe", tokens),
]

#: The token ids are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
