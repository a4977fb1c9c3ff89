"""Registered queries of the subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
import shelflink.llm
from shelflink.llm import oracles
from shelflink.llm.centroids import clustered
from shelflink.llm.common import table
from shelflink.llm.embedding_dedup import near_vectors
from shelflink.llm.exact_dedup import exact_groups
from shelflink.llm.html_text import extract_text
from shelflink.llm.licenses import license_scan
from shelflink.llm.mixing import mix
from shelflink.llm.near_dedup import near_duplicates
from shelflink.llm.quality_classifier import scored as quality_scored
from shelflink.llm.quality_rules import judged
from shelflink.llm.resampling import resampled
from shelflink.llm.secrets import secret_digests
from shelflink.llm.sentence_pieces import encoded_and_checked
from shelflink.llm.toxicity import scored as toxicity_scored

# Workers need not have this folder on their path.
cloudpickle.register_pickle_by_value(shelflink.llm)
cloudpickle.register_pickle_by_value(corpus_pipeline)


def op1_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_licenses(spark: SparkSession, d: str) -> DataFrame:
    return license_scan(table(spark, d, "documents"))


def op3_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_groups(table(spark, d, "documents"))


def op4_html_text(spark: SparkSession, d: str) -> DataFrame:
    return extract_text(table(spark, d, "pages"))


def op5_sentence_pieces(spark: SparkSession, d: str) -> DataFrame:
    return encoded_and_checked(table(spark, d, "documents"))


def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return judged(table(spark, d, "documents"))


def op7_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secret_digests(table(spark, d, "documents"))


def op8_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"), words=2)


def op9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality_scored(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity_scored(table(spark, d, "documents"), table(spark, d, "labels"))


def op11_vector_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_vectors(table(spark, d, "embeddings"))


def op12_resample(spark: SparkSession, d: str) -> DataFrame:
    rows = resampled(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_centroids(spark: SparkSession, d: str) -> DataFrame:
    return clustered(table(spark, d, "embeddings"))


def registered() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {
        "op1_source_mix": (op1_source_mix, oracles.SOURCE_MIX),
        "op2_licenses": (op2_licenses, None),
        "op3_exact_dedup": (op3_exact_dedup, oracles.EXACT_DEDUP),
        "op4_html_text": (op4_html_text, None),
        "op5_sentence_pieces": (op5_sentence_pieces, None),
        "op6_quality_rules": (op6_quality_rules, None),
        "op7_secrets": (op7_secrets, None),
        "op8_near_dedup": (op8_near_dedup, oracles.NEAR_DEDUP),
        "op9_quality": (op9_quality, None),
        "op10_toxicity": (op10_toxicity, None),
        "op11_vector_dedup": (op11_vector_dedup, oracles.VECTOR_DEDUP),
        "op12_resample": (op12_resample, oracles.RESAMPLE),
        "op13_centroids": (op13_centroids, oracles.CENTROIDS),
        "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    }
