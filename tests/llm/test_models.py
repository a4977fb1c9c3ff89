"""Classifiers on held-out rows, and their index and calibration against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelflink.llm import quality_classifier, toxicity
from shelflink.llm.common import isotonic
from shelflink.llm.toxicity import BLOCK, BlockMaxIndex, unit

EMPTY = [(9000, None), (9001, ""), (9002, " \n"), (None, "the text of no one"), (9003, "wort " * 40_000), (9003, "x")]


def _remainder(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def _corpus(n: int) -> tuple[list, list]:
    rng = random.Random(3)
    docs, labels = [], []
    words = ["the", "house", "river", "walks", "green", "slowly", "under", "stone", "morning", "light"]
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.25
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["Blockhead", "numbskull,", "nincompoop"])
        joined = " ".join(text) if good else " ".join(w.upper() + "!!" for w in text)
        docs.append((i, joined))
        if rng.random() < 0.8:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def corpus():
    return _corpus(500)


@pytest.mark.parametrize(("module", "modulus", "held", "label"), [(quality_classifier, 5, 0, 1), (toxicity, 3, 1, 2)])
def test_held_out_accuracy(docs_of, labels_of, corpus, module, modulus, held, label):
    docs, labels = corpus
    rows = module.scored(docs_of([*docs, *EMPTY]).withColumn("score", F.lit("clash")), labels_of(labels)).collect()
    assert len(rows) == len(docs) + len(EMPTY)
    truth = {row[0]: row[label] for row in labels}
    right = []
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
        if r.doc_id is not None:
            assert r.held_out == (_remainder(r.doc_id, modulus) == held)
            if r.held_out and r.doc_id in truth:
                right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) >= 0.95


@pytest.mark.parametrize(("module", "modulus", "held"), [(quality_classifier, 5, 0), (toxicity, 3, 1)])
def test_held_out_labels_and_other_columns_do_not_matter(docs_of, labels_of, corpus, module, modulus, held):
    docs, labels = corpus
    flipped = [(d, 1 - q, 1 - t) if _remainder(d, modulus) == held else (d, q, t) for d, q, t in labels]
    odd = [(None, 1, 1), (3, None, None), (10**6, 0, 1)]

    def scores(rows, known, lang):
        out = module.scored(docs_of(rows).withColumn("lang", F.lit(lang)), labels_of(known))
        return sorted((r.doc_id, round(r.score, 9)) for r in out.collect())

    assert scores(docs, labels, "en") == scores(docs[::-1], [*flipped, *odd], "xx")


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_edge_tables(docs_of, labels_of, module):
    docs = docs_of(EMPTY)
    assert {r.score for r in module.scored(docs, labels_of([])).collect()} == {0.5}
    assert module.scored(docs_of([]), labels_of([])).count() == 0
    one = module.scored(docs, labels_of([(9000, 1, 0), (9001, 1, 0), (9002, 1, 0), (9003, 1, 0)])).collect()
    assert len(one) == len(EMPTY) and all(0 <= r.score <= 1 for r in one)


def test_rejected_documents_go(docs_of, labels_of, corpus):
    docs, labels = corpus
    rows = docs_of(docs).withColumn("score", F.lit(2.0))
    kept = quality_classifier.good_documents(rows, labels_of(labels))
    assert kept.columns == rows.columns
    want = {r.doc_id for r in quality_classifier.scored(rows, labels_of(labels)).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want != set()


def test_block_max_search_against_all_examples():
    rng = np.random.default_rng(1)
    terms = [f"t{i}".encode() for i in range(30)]
    idf = rng.uniform(1, 5, 30)
    vectors = [unit(Counter(rng.integers(0, 30, rng.integers(1, 6)).tolist()), idf) for _ in range(BLOCK * 7 + 3)]
    ids = rng.permutation(len(vectors)).tolist()
    index = BlockMaxIndex(terms, idf, ids, vectors, [0.0] * len(ids))
    for _ in range(60):
        query = unit(Counter(rng.integers(0, 30, 4).tolist()), idf)
        cos = {d: sum(w * v.get(t, 0.0) for t, w in query.items()) for d, v in zip(ids, vectors, strict=True)}
        want = sorted(((-round(c, 9), d) for d, c in cos.items() if c > 0))[:15]
        at, got = index.nearest(query)
        assert index.ids[at].tolist() == [d for _, d in want]
        assert got == pytest.approx([-c for c, _ in want])


def test_isotonic_against_quadratic_search():
    rng = np.random.default_rng(2)
    for _ in range(30):
        mean, weight = rng.random(7), rng.integers(1, 5, 7).astype(float)
        got = isotonic(mean, weight)
        assert (np.diff(got) >= 0).all()
        # Largest of the lower means over all intervals, the textbook formula.
        want = [
            max(
                min(np.average(mean[a : b + 1], weights=weight[a : b + 1]) for b in range(i, 7)) for a in range(i + 1)
            )
            for i in range(7)
        ]
        assert got == pytest.approx(want)
