"""Corpus preparation: known languages, not toxic, no near-duplicates, packed.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import language_id, near_dups, packing, toxicity
from ledgerlens.llm.shared import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose fused evidence names a language; the model learns from the declared languages, and without any all stay."""
    return language_id.keep_known(docs, language_id.train(docs, strict=False))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier chain does not call toxic; it learns from the labels of the documents still there, and without toxic ones all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, strict=False))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group whose five-word shingles overlap by 0.8 or more."""
    return near_dups.without_near_duplicates(docs, shingle=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents that are left into sequences of 2048 tokens; one row per piece, with its ids (four bytes each)."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language_id", known_language), ("toxicity", not_toxic), ("near_dedup", one_of_each), ("packing", packed)]

#: Trained models and minwise sketches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
