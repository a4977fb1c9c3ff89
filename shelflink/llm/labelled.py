"""Training rows for the classifiers: a bounded sample of labels, found again in the documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.llm.common import isotonic, text_of

BINS = 400


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def training_texts(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """doc_id, text, y (0 to 1), fold (true: for calibration) of at most ``rows`` labelled documents.

    ``labels`` (doc_id, ``label``) gives one target per document, the mean of its rows; the sample is
    the ``rows`` smallest hashes, so it is the same on every run. It is at most ``rows`` times 24
    bytes and is broadcast. Repeated documents count as often as they come.
    """
    known = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    target = known.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    order = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("long"))
    sample = target.withColumn("_h", order).orderBy("_h", "doc_id").limit(rows)
    sample = sample.select(F.col("doc_id").alias("_doc"), "y", (F.pmod("_h", F.lit(5)) == 0).alias("fold"))
    texts = docs.select("doc_id", text_of().alias("text"))
    return texts.join(F.broadcast(sample), texts["doc_id"] == sample["_doc"]).drop("_doc")


def calibration(bins: list[tuple[int, float, int]], rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps through (bin, sum of y, rows), each smoothed by one row of the overall rate."""
    bins = sorted(bins)
    if not bins:
        return np.array([0.0, 1.0]), np.array([rate, rate])
    at = np.array([b for b, _, _ in bins], float) / BINS
    weight = np.array([n for _, _, n in bins], float)
    value = isotonic(np.array([s for _, s, _ in bins]) / weight, weight)
    # Rows of a step share its evidence.
    pooled = np.array([weight[value == v].sum() for v in value])
    value = (value * pooled + rate) / (pooled + 1)
    return at, np.maximum.accumulate(value)


def bin_of(score: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(score * BINS), -BINS, 2 * BINS).astype(np.int64)


def calibrated(score: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.interp(bin_of(score) / BINS, *steps), 0.0, 1.0)
