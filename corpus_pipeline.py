"""A corpus pipeline: documents in, training tokens out. Each stage is one operator."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality
from tidemark.session import save_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a risk-controlled threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.drop_rejected(docs, labels, quality.Control(pool_small=True))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id stays."""
    return near_dedup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often, or as far, as the mix takes them; repeats are rows of their own."""
    return mixing.mix_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = docs.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    decoded = byte_bpe.encode(kept, path, public_tokenizers.PATTERN, bytes_col="decoded")
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("__sha")).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before kept, written and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, last = [stage for _, stage in STAGES]
    kept = functools.reduce(lambda d, stage: save_stage(stage(spark, d, sf_dir)), first, docs)
    return last(spark, kept, sf_dir)


# Near duplicates need signatures and connected components, which SQL cannot express.
ORACLE_SQL = None
