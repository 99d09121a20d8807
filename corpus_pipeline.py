"""A text pipeline over ``documents``: quality filter, near-dedup, decontamination, byte-level BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame. ``run`` writes each stage's rows as Parquet to the
shared folder and reads them again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.bpe import bpe_encode
from flowgauge.llm.common import written
from flowgauge.llm.decontam import decontaminate
from flowgauge.llm.quality import keep_quality
from flowgauge.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier scores 0.3 or more; all columns."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group; all columns."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words at least one in twenty lies in benchmark windows; all columns."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text: doc_id, packed ids and their number, and whether they decode to the text."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe_encode(docs.select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN, decoded="decoded")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select(
        "doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), (F.col("decoded") == text).alias("exact")
    )


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: The classifier's weights and the 256-bit fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
