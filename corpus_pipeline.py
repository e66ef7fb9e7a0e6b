"""A training-data pipeline over ``documents``: five stages, each on all rows
that its predecessor kept, written as Parquet in between.

Rows keep the columns of documents up to the last stage, which returns the
encoded mix. Stages 2 and 3 keep one row of each group, also where ids are null
or repeat.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe, exact_dedup, mixing, near_dedup, quality
from veilspark.plans.session import settle

#: Texts that score less go.
QUALITY_LIMIT = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go. The model learns from the labelled rows of
    the stage's own input."""
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.rejects(docs, machine, QUALITY_LIMIT)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays, of the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row stays, of the smallest id."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, shard by shard in mixed order."""
    return mixing.remix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, text decoded from them."""
    words = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, words)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("exact dedup", drop_exact),
    ("MinHash near-dedup", drop_near),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encode),
]

#: Trained scores and random draws are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
