"""Corpus pipeline: quality filter, exact and near deduplication, source mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to
the shared folder and rereads as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelflink.llm.common import Scratch, table
from shelflink.llm.exact_dedup import without_copies
from shelflink.llm.mixing import mixed
from shelflink.llm.near_dedup import without_near_copies
from shelflink.llm.quality_classifier import good_documents
from shelflink.llm.sentence_pieces import encoded_and_checked


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded_and_checked(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("sentence pieces", to_tokens),
]

#: A kernel classifier and MinHash have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for nth, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir), f"stage-{nth + 1}")
        if nth:
            scratch.drop(before)
    return docs
