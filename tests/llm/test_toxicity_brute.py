"""The whole operator against plain Python: neighbours, votes, calibration and scores of every text."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from shelflink.llm import toxicity
from shelflink.llm.common import Scratch
from shelflink.llm.labelled import BINS, bin_of, calibrated, calibration
from shelflink.llm.toxicity import NEAREST, TELLING, VOTERS, examples_of, fit_toxicity, scored, tokens


def _corpus(n: int) -> tuple[list, list]:
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        toxic = rng.random() < 0.3
        if toxic and rng.random() < 0.8:
            text += [rng.choice(["Nitwit", "oaf!", "dunce"])] * rng.randint(1, 2)
        if i % 9 == 0:
            text.append(f"only{i}")
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_scores_and_evidence_against_brute_force(spark, docs_of, labels_of):
    docs, labels = _corpus(700)
    docs += [(5000, "never seen before"), (5001, None), (5002, docs[4][1])]
    frame = docs_of(docs)
    sample = {r.doc_id: r.fold for r in examples_of(frame, labels_of(labels), "toxic", 20_000, 1 << 20, Scratch(spark, "t")).collect()}
    assert set(sample) == {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}

    counts = [Counter(tokens(t or "")) for _, t in docs]
    df = Counter(w for c in counts for w in c)
    train = [(d, c, dict((i, t) for i, _, t in labels)[d]) for (d, _), c in zip(docs, counts, strict=True) if d in sample]
    vocabulary = {w for _, c, _ in train for w in c}
    idf = {w: math.log((len(docs) + 1) / ((df[w] if w in vocabulary else 1) + 1)) + 1 for w in df}

    def vector(c):
        v = {w: (1 + math.log(n)) * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    fit = [(c, y) for d, c, y in train if not sample[d]]
    n, positive, telling = len(fit), sum(y for _, y in fit), set()
    for w in vocabulary:
        a, d = sum(y for c, y in fit if w in c), sum(w in c for c, _ in fit)
        b, other = d - a, n - positive
        chi2 = n * (a * other - b * positive) ** 2 / (positive * other * d * (n - d) + 1e-9)
        lift = ((a + 0.5) / (positive + 1)) / ((b + 0.5) / (other + 1))
        if d >= 4 and chi2 >= 25 and (lift >= 3 or lift <= 1 / 3):
            telling.add(w)
    assert {b"nitwit", b"oaf", b"dunce"} <= telling
    vectors = [(d, vector(c), y) for d, c, y in train]

    def vote(c, without=()):
        q = vector(c)
        cos = [(-round(sum(x * v.get(w, 0.0) for w, x in q.items()), 9), d, v, y) for d, v, y in vectors if d not in without]
        near = sorted(x for x in cos if x[0] < 0)[:VOTERS]
        weight = [(1 + TELLING * len(telling & q.keys() & v.keys())) / (1 + max(s, -1) + 0.05) for s, _, v, _ in near]
        share = sum(w * y for w, (_, _, _, y) in zip(weight, near, strict=True)) / sum(weight) if near else 0.0
        return share, [d for _, d, _, _ in near[:NEAREST]]

    held = {d for d in sample if sample[d]}
    bins: dict[int, list] = {}
    for _, c, y in (x for x in train if x[0] in held):
        step = bins.setdefault(int(bin_of(np.array([vote(c, held)[0]]))[0]), [0, 0])
        step[0] += y
        step[1] += 1
    rate = sum(y for _, _, y in train) / len(train)
    steps = calibration([(b, s, m) for b, (s, m) in bins.items()], rate)
    got = {r.doc_id: r for r in scored(frame, labels_of(labels)).collect()}
    assert len(got) == len(docs)
    differ = 0
    for (d, _), c in zip(docs, counts, strict=True):
        if not c.keys() & vocabulary:
            assert got[d].score == pytest.approx(rate) and got[d].neighbours == [] and got[d].terms == []
            continue
        share, near = vote(c)
        assert got[d].neighbours == near
        assert sorted(got[d].terms) == sorted(w.decode() for w in telling & c.keys())
        # A vote on the edge of two bins may round to either.
        if abs(share * BINS % 1 - 0.5) > 1e-6:
            assert got[d].score == pytest.approx(float(calibrated(np.array([share]), steps)[0]))
        else:
            differ += 1
    assert differ < 5


def test_the_sample_is_bounded(spark, docs_of, labels_of):
    docs = [(i, f"text number {i} " * 5) for i in range(60)] + [(0, "text")] * 50 + [(3, f"other {i}") for i in range(50)]
    labels = [(i, 1, i % 2) for i in range(60)]
    one = examples_of(docs_of(docs), labels_of(labels), "toxic", 1000, 1 << 20, Scratch(spark, "t")).collect()
    assert len({r.doc_id for r in one}) == len(one) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    few = examples_of(docs_of(docs), labels_of(labels), "toxic", 1000, 1000, Scratch(spark, "t")).collect()
    assert 0 < sum(len(r.text) for r in few) <= 1000 and {r.doc_id for r in few} < {r.doc_id for r in one}
    assert fit_toxicity(docs_of(docs), labels_of(labels), size=0) is None


@pytest.mark.parametrize("seed", range(3))
def test_blocks_that_are_skipped_hold_no_neighbour(seed, monkeypatch):
    """Many rare terms, so that nearly all postings lie outside the columns."""
    monkeypatch.setattr(toxicity, "DENSE", 8)
    rng = np.random.default_rng(seed)
    m = 400
    idf = rng.uniform(1, 8, m)

    def some(size):
        return toxicity.unit(Counter((rng.zipf(1.3, size) % m).tolist()), idf)

    vectors = [some(rng.integers(1, 30)) for _ in range(64 * 40 + 7)]
    ids = rng.permutation(len(vectors)).tolist()
    index = toxicity.BlockMaxIndex([f"t{i}".encode() for i in range(m)], idf, ids, vectors, [0.0] * len(ids))
    queries = [some(rng.integers(1, 20)) for _ in range(50)] + [{}]
    for query, (at, got, _) in zip(queries, index.nearest_of(queries, 7), strict=True):
        cos = sorted((-round(sum(w * v.get(t, 0.0) for t, w in query.items()), 9), d) for d, v in zip(ids, vectors, strict=True))
        want = [(c, d) for c, d in cos if c < 0][:7]
        assert got == pytest.approx([-c for c, _ in want])
        # Rounding may swap equals only.
        assert all(abs(cos_of - c) < 2e-9 for cos_of, (c, _) in zip(-got, want, strict=True))
        assert len(set(index.ids[at].tolist()) & {d for _, d in want}) >= len(want) - 1
