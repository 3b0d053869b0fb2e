"""From raw documents to packed training sequences.

Stages in order: documents without a language go; of equal texts one stays; of each
group of near-duplicates one stays; sources are mixed to their weights by leaving
out and repeating documents; what is left is tokenized and packed. Each stage reads
what its predecessor wrote, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catalign.llm import exact_dedup, language_id, mixing, near_dup, packing
from catalign.llm.common import table
from catalign.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = language_id.fit(docs.filter(~language_id.is_held_out("doc_id")))
    return language_id.keep_identified(docs, known)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_to_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language), ("exact_dedup", drop_exact), ("near_dup", drop_near), ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express language identification, sampling by weight or packing; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
