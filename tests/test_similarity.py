from __future__ import annotations

import random

import brute
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelflink.functions import similarity as sim

TEXT = st.text(alphabet="abcd é\x00漢😀", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=8))
def test_kernels_match_definition(pairs):
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert sim.lcs_lengths(left, right).tolist() == [brute.lcs(a, b) for a, b in pairs]
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    got = sim.best_window_ratios([a for a, _ in ordered], [b for _, b in ordered])
    for value, (a, b) in zip(got, ordered):
        windows = [b[i : i + len(a)] for i in range(len(b))] if a else []
        want = max((2 * brute.lcs(a, w) / (len(a) + len(w)) for w in windows), default=0)
        assert value == want


def test_kernels_on_long_texts():
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    sizes = [(63, 64), (64, 64), (64, 65), (65, 65), (90, 200), (130, 131), (1, 300)]
    pairs = [(text(m), text(n)) for m, n in sizes]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert sim.lcs_lengths(left, right).tolist() == [brute.lcs(a, b) for a, b in pairs]
    got = sim.best_window_ratios(left, right)
    for value, (a, b) in zip(got, pairs):
        windows = [b[i : i + len(a)] for i in range(len(b))]
        assert value == max(2 * brute.lcs(a, w) / (len(a) + len(w)) for w in windows)


def measures(spark, pairs):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    rows = rows.withColumns(
        {"sa": sim.sorted_tokens(F.col("a")), "sb": sim.sorted_tokens(F.col("b"))}
    )
    return (
        sim.with_token_set_ratio(rows, "sa", "sb", "tset")
        .select(
            "i",
            sim.ratio(F.col("a"), F.col("b")).alias("ratio"),
            sim.partial_ratio(F.col("a"), F.col("b")).alias("partial"),
            sim.ratio(F.col("sa"), F.col("sb")).alias("tsort"),
            "tset",
        )
        .orderBy("i")
        .collect()
    )


def test_measures_match_definition(spark):
    rng = random.Random(11)
    words = ["dune", "messiah", "the", "of", "ha", "é", "naïve", "x_1", "½", "Emma!", "-", "漢字"]
    pairs = [
        tuple(" ".join(rng.choices(words, k=rng.randrange(0, 7))) for _ in range(2))
        for _ in range(250)
    ]
    pairs += [("", ""), ("", "a"), ("same", "same"), ("!!", "??"), ("abc", "xabcx")]
    for row, (a, b) in zip(measures(spark, pairs), pairs):
        want = (brute.ratio(a, b), brute.partial(a, b), brute.token_sort(a, b), brute.token_set(a, b))
        assert (row.ratio, row.partial, row.tsort, row.tset) == want, (a, b)
    back = measures(spark, [(b, a) for a, b in pairs])
    for one, two in zip(measures(spark, pairs), back):
        assert (one.ratio, one.tsort, one.tset) == (two.ratio, two.tsort, two.tset)
        assert all(0 <= v <= 100 for v in one[1:])


def test_missing_text_scores_zero(spark):
    row = measures(spark, [(None, "dune"), ("dune", None)])
    assert [tuple(r[1:]) for r in row] == [(0, 0, 0, 0)] * 2
