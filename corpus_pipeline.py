"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.

Cases: an empty table gives an empty result; null and empty texts have no letter and go in the first
stage; equal texts, ties and long texts are as the operators have them; columns besides those of
``documents``, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from tidemark.llm.common import documents, forget, write_and_reread
from tidemark.shipping import ensure_shipped


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letter) go; those without a ``lang`` get the one predicted."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the one with most code points stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 or more of their word 5-grams, the least id stays."""
    return jaccard_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order whose sources interleave at the target weights."""
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, mix_at (by which rows sort in the mixed order), n_tokens and the digests of ids and decoded text."""
    return bpe.round_trip(docs.withColumn("mix_at", mixing.stored_order()), keep=("mix_at",))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The encoding has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    ensure_shipped(spark)
    docs = documents(spark, sf_dir)
    before = None
    for name, stage in STAGES[:-1]:
        made = write_and_reread(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)  # a stage reads its predecessor's table alone
        docs = before = made
    return STAGES[-1][1](spark, docs, sf_dir)
