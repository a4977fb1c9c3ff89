"""Quality of documents: a Gaussian-kernel ridge score over document statistics.

Statistics of the text (lengths, shares of character classes, repetition) are standardised and
mapped by random Fourier features, whose inner products approximate a Gaussian kernel. Every
partition of the training rows sums its own normal equations; the sums are added and solved for
ridge weights. Scores of held-back training rows are calibrated by isotonic regression.

Bound of the fit: ``TRAIN_ROWS`` labelled documents, chosen by hash. Everything else covers all rows.
NULL text counts as empty; empty texts are scored like any other. Without any labelled document the
score is 0.5. Repeated rows are scored each. Rows without ``doc_id`` are scored, never learned from.
Other columns are ignored. Labels that are NULL are left out; differing labels of a document average.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.llm.common import Scratch, text_of
from shelflink.llm.labelled import bin_of, calibrated, calibration, remainder, training_texts

TRAIN_ROWS = 20_000
FEATURES = 256
RIDGE = 1e-2
THRESHOLD = 0.3
FIT_PARTITIONS = 16
SEED = 9


def _class(characters: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(characters)] = 1
    return mask


UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: One row per character class: upper, lower, digits, symbols, marks of emphasis, stops, other
#: punctuation, line ends, other white space, bytes of non-ASCII characters.
CLASSES = np.stack(
    [
        _class(c)
        for c in (
            UPPER, LOWER, b"0123456789", b"#*$%&|<>", b"!?", b".,", b";:'\"()-_/[]{}@+=~^\\`", b"\n",
            b" \t\r\x0b\x0c", bytes(range(128, 256)),
        )
    ]
).T


def statistics(text: str) -> np.ndarray:
    """Statistics of one text; shares lie between 0 and 1."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n, bytes_ = max(1, len(words)), max(1, len(data))
    p = counts[counts > 0] / bytes_
    letters = counts[65:91].sum() + counts[97:123].sum()
    return np.concatenate(
        [
            [
                np.log1p(len(words)),
                np.log1p(len(data) / n),
                np.log1p(n / max(1, len(lines))),
                len(set(words)) / n,
                len(set(lines)) / max(1, len(lines)),
                counts[65:91].sum() / max(1, letters),
                float(-(p * np.log(p)).sum()) / 4,
            ],
            counts @ CLASSES / bytes_,
        ]
    )


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.scale).clip(-5, 5) @ self.directions + self.phases)
        return np.column_stack([z * np.sqrt(2 / len(self.phases)), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights


def _stack(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _with_statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        x = [statistics(t).tobytes() for t in batch["text"]]
        yield pd.DataFrame({"x": x, "y": batch["y"], "fold": batch["fold"]})


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        if len(batch):
            x = _stack(batch["x"])
            add = np.stack([x.sum(axis=0), (x * x).sum(axis=0), np.full(x.shape[1], len(x)), np.full(x.shape[1], batch["y"].sum())])
            total = add if total is None else total + add
    if total is not None:
        yield pd.DataFrame({"sums": [total.tobytes()]})


def _normal_equations(model: QualityModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(model.phases) + 1
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if len(batch):
                z = model.features(_stack(batch["x"]))
                left += z.T @ z
                right += z.T @ batch["y"].to_numpy()
        yield pd.DataFrame({"sums": [np.column_stack([left, right]).tobytes()]})

    return run


def _bins(model: QualityModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"bin": bin_of(model.raw(_stack(batch["x"]))), "y": batch["y"]})

    return run


def _added(df: DataFrame) -> np.ndarray | None:
    """Sum of the arrays of ``df``: one row a partition, of at most FIT_PARTITIONS."""
    parts = [np.frombuffer(r["sums"]) for r in df.collect()]
    return np.sum(parts, axis=0) if parts else None


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel | None:
    """Model of ``label``, learned where crc32(doc_id) mod 5 is not 0; None without such rows."""
    scratch = Scratch(docs.sparkSession, "quality-fit")
    train = training_texts(docs, labels, label, remainder(5) != 0, rows)
    train = scratch.put(train.mapInPandas(_with_statistics, "x binary, y double, fold boolean"), "train")
    sums = _added(train.coalesce(FIT_PARTITIONS).mapInPandas(_moments, "sums binary"))
    if sums is None:
        return None
    total, squares, n, positive = sums.reshape(4, -1)
    mean = total / n
    random = np.random.default_rng(SEED)
    model = QualityModel(
        mean,
        np.sqrt(np.maximum(squares / n - mean**2, 1e-6)),
        random.normal(size=(len(mean), FEATURES)) / np.sqrt(len(mean)),
        random.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1),
        (np.zeros(1), np.zeros(1)),
    )
    fitted = train.where("NOT fold").coalesce(FIT_PARTITIONS)
    equations = _added(fitted.mapInPandas(_normal_equations(model), "sums binary"))
    if equations is not None:
        equations = equations.reshape(FEATURES + 1, FEATURES + 2)
        left, right = equations[:, :-1].copy(), equations[:, -1]
        left[np.diag_indices(FEATURES)] += RIDGE * n[0] / FEATURES
        left[-1, -1] += 1e-9
        model.weights = np.linalg.solve(left, right)
    binned = train.where("fold").mapInPandas(_bins(model), "bin long, y double")
    bins = binned.groupBy("bin").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()
    model.steps = calibration([tuple(r) for r in bins], float(positive[0] / n[0]))
    scratch.drop(train)
    return model


def quality_score(model: QualityModel | None, text: Column | str = "text") -> Column:
    """Calibrated probability that the text is good."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            if model is None:
                yield pd.Series(np.full(len(batch), 0.5))
            elif len(batch):
                x = np.stack([statistics(t) for t in batch])
                yield pd.Series(calibrated(model.raw(x), model.steps))
            else:
                yield pd.Series(np.zeros(0))

    return score(text_of(text))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    rated = docs.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), quality_score(fit_quality(docs, labels)).alias("score")
    )
    return rated.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; same columns."""
    score = quality_score(fit_quality(docs, labels)).alias("score")
    # Whole rows in one column, so no name can clash.
    return docs.select(F.struct("*").alias("row"), score).where(F.col("score") >= THRESHOLD).select("row.*")
