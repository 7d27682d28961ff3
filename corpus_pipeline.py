"""From `documents` to token ids: quality, exact and near copies, mix of sources, BPE. Counted as part of lodestone.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import bpe_encode
from lodestone.llm.common import stored
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.mixing import mix_sources
from lodestone.llm.near_dedup import near_duplicates
from lodestone.llm.quality import fit_quality, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; null and empty texts are scored too, repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, fit_quality(docs, labels)).where("predicted = 1").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id; null texts are equal to empty ones, and of rows that repeat id and text one stays."""
    return exact_dedup(docs).where("kept").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 or more, the one with the smallest doc_id. Rows that share a doc_id are one document; those without one, or without words, stay."""
    gone = near_duplicates(docs, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; those of small sources up to 1.5 times as often as those of the largest. A null source is one of its own with the empty one."""
    return mix_sources(docs, repetition_limit=1.5).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the SHA-256 of ids and decoded text; a null text counts as empty, repeated rows come out each."""
    out = bpe_encode(docs, decode=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("bpe", encode)]

#: A trained classifier and a tokenizer library are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
