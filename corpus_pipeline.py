"""The corpus pipeline: quality, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the
columns of documents. ``run`` applies them to ``documents``, writing each stage's rows to the shared folder, so
that lineage is cut and a lost executor costs a task, not a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sluice.llm import langid, minhash, packing, quality, secret_scan
from sluice.llm.common import Scratch, final

#: Rows with a smaller language score are rejected, as are those without a letter.
LANG_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the compression classifier predicts as bad; it learns from all labelled rows."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in none of the learned languages."""
    return langid.accepted(docs, langid.learn(docs), least=LANG_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return minhash.drop_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and keeps every document."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining texts into sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Compression, cross-parsing, signatures, entropy and packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir))
        return final(STAGES[-1][1](spark, docs, sf_dir))
