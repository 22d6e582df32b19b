"""A training corpus from documents: drop low quality, drop copies, drop near copies, mix sources, tokenise.

Every stage gets what its predecessor kept, as Parquet, and works on all of it. All but the last return the columns
of ``documents``. Nulls, empty and long texts, repeated rows, empty tables and further columns are handled as the
operators define: the classifier scores empty texts by its rules; equal texts leave the row with the largest id;
a near group leaves the row with the smallest; the mix repeats or drops rows, a text without words is never taken;
the last stage gives one row per taken copy with its token ids.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterwork.llm import byte_bpe, exact, mixing, queries, rule_ensemble, simhash  # noqa: E402
from meterwork.session import staging_root, use_settings  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts (score 0.7 or more); it learns from the labels outside the held-out fold."""
    return rule_ensemble.accepted(docs, queries.quality_model(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact.without_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by fingerprints of four or fewer differing bits."""
    return simhash.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the target weights take it."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the SHA-256 of the ids and of the decoded bytes, per row of the mix."""
    return byte_bpe.round_trip(docs.select("doc_id", "source", "text"), queries.tokenizer())


def _with_settings(stage):
    """Stages are also called one by one on sessions of others: day keys in UTC, Arrow batches of a few megabytes."""
    return lambda spark, docs, sf_dir: stage(use_settings(spark), docs, sf_dir)


STAGES = [(f.__name__, _with_settings(f)) for f in (quality, exact_copies, near_copies, mix, tokens)]

#: The classifier and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{staging_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
