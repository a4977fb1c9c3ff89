"""Best match without the window measure of every pair: same rows, fewer windows."""

from __future__ import annotations

import random

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelflink.functions import similarity as sim
from shelflink.operators import scoring
from shelflink.scratch import written

WORDS = "dune messiah emma coast the of long river ring small harbour night letters sea".split()
PAIR = "query_id long, q_variation int, listing_id long, l_variation int, q_text string, l_text string"


def lcs_rows(rng, sizes, alphabet):
    def text(n):
        return "".join(rng.choices(alphabet, k=n))

    return [(text(m), text(n)) for m, n in sizes]


@pytest.mark.parametrize("rows_a_word", [0, 10**9])
def test_common_subsequence_over_several_machine_words(monkeypatch, rows_a_word):
    monkeypatch.setattr(sim, "ROWS_A_WORD", rows_a_word)
    rng = random.Random(rows_a_word)
    edges = (1, 63, 64, 65, 127, 128, 129, 192, 193)
    sizes = [(m, n) for m in edges for n in edges] + [(600, 640)]
    for alphabet in ("a", "ab", "abcdefgh é漢"):
        pairs = lcs_rows(rng, sizes, alphabet)
        got = sim.lcs_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist()
        assert got == [brute.lcs(a, b) for a, b in pairs]
    (long,) = lcs_rows(rng, [(5000, 5003)], "abcdefgh ")
    assert sim.lcs_lengths([long[0], long[0], "x"], [long[1], long[0], ""]).tolist() == [brute.lcs(*long), 5000, 0]


def pairs_of(spark, seed, n_queries, n_listings):
    rng = random.Random(seed)

    def title():
        return " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 3, 4, 5, 15])))

    rows = []
    for q in range(n_queries):
        texts = [title() for _ in range(1 + q % 2)]
        # The first query owns a third of all pairs.
        for listing in range(n_listings * (n_queries // 2 if q == 0 else 1)):
            offer = title() if listing % 7 else texts[0]
            rows += [(q, i, listing, 0, t, offer) for i, t in enumerate(texts)]
    rows.append((n_queries, 0, 0, 0, "", ""))
    rows.append((n_queries + 1, 0, 0, 0, None, "dune"))
    sides = {f"{s}_sorted": sim.sorted_tokens(F.col(f"{s}_text")) for s in "ql"} | {f"{s}_main": F.col(f"{s}_text") for s in "ql"}
    return written(spark.createDataFrame(rows, PAIR).withColumns(sides), "pairs")


def test_best_pairs_are_those_of_all_scores(spark):
    pairs = pairs_of(spark, 5, 12, 60)
    scored = written(scoring.score_pairs(pairs), "scored")
    want = sorted(scoring.best_per_query(scored, "query_id").collect())
    for skew in ({}, {"hot_rows": 1}):
        assert sorted(scoring.best_pairs(pairs, "query_id", **skew).collect()) == want
    # What ``need`` leaves out stays below it.
    keys = ["query_id", "q_variation", "listing_id", "l_variation", "base_score"]
    reached = [sorted(t.where(F.floor("base_score") >= 72).select(keys).collect()) for t in (scored, scoring.score_pairs(pairs, need=72))]
    assert reached[0] == reached[1] and reached[0]


def test_bound_holds_and_spares_windows(spark):
    pairs = pairs_of(spark, 3, 12, 60)
    bounded = written(scoring.with_bound(pairs), "bounded")
    scored = scoring.score_pairs(pairs).select("query_id", "q_variation", "listing_id", "l_variation", "base_score")
    keys = ["query_id", "q_variation", "listing_id", "l_variation"]
    assert bounded.join(scored, keys).where("bound < base_score").count() == 0
    left = scoring.contenders(bounded.where("bound > 0"), "query_id")
    assert left.count() < pairs.count() / 4
    # Without the longest common subsequence the bound would be that of a perfect window.
    assert bounded.where(F.col("bound") < 60).count() > 0


def test_no_pairs(spark):
    assert scoring.best_pairs(pairs_of(spark, 1, 2, 1).limit(0), "query_id").collect() == []


def test_pairs_that_cannot_win_cost_no_window(monkeypatch):
    """Of every key, the best pairs keep their window measure; most others are not measured."""
    rng = random.Random(5)
    words = "the harbour night letters of sorcerer long river".split()
    texts = [(" ".join(rng.choices(words, k=3)) + "x", " ".join(rng.choices(words, k=6))) for _ in range(400)]
    keys = pd.Series([k % 9 if k % 9 else None for k in range(400)])
    short, long = (pd.Series(side) for side in zip(*texts))
    measures = np.rint(100 * sim.best_window_ratios(list(short), list(long)))
    fixed = pd.Series([100.0 if k % 50 == 0 else None for k in range(400)])
    measures = np.where(fixed.notna(), 100.0, measures)
    least = pd.Series(np.round([rng.uniform(20, 60) for _ in range(400)]))
    bound = least + 0.2 * np.minimum(100, measures + [rng.randrange(20) for _ in range(400)])
    scores = (least + 0.2 * measures).to_numpy()
    measured, windows = [], sim.best_window_ratios

    def watched(short, long):
        measured.extend(short)
        return windows(short, long)

    monkeypatch.setattr(sim, "best_window_ratios", watched)
    got = sim._winning_batch(keys, least, least + 20, bound, fixed, short.where(fixed.isna()), long.where(fixed.isna()))
    assert len(measured) < 120
    for key in range(9):
        rows = np.flatnonzero((keys.isna() if key == 0 else keys == key).to_numpy())
        for k in rows[scores[rows] >= scores[rows].max() - 1e-9]:
            assert fixed.notna()[k] or np.rint(100 * got[k]) == measures[k]
