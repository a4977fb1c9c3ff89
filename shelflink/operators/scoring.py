"""Scores of title pairs and what is decided from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.functions.ids import same_prefix
from shelflink.functions.similarity import (
    lcs_length,
    most_partial,
    partial_ratio,
    ratio_of,
    sorted_tokens,
    with_token_set_ratio,
    with_winning_partial,
)
from shelflink.operators.lookup import lookup_join
from shelflink.scratch import written

# Fixed values.
WEIGHTS = {"ratio": 0.15, "partial_ratio": 0.2, "token_sort_ratio": 0.25, "token_set_ratio": 0.4}
LONG_WEIGHTS = {"ratio": 0.1, "partial_ratio": 0.1, "token_sort_ratio": 0.2, "token_set_ratio": 0.6}
LONG_TITLE = 50
FEW_WORDS, FEW_WORDS_FACTOR = 3, 0.7
LONG_SUM, LONG_GAP, LONG_GAP_FACTOR = 100, 30, 0.95
SHORT_GAP, SHORT_GAP_FACTOR = 10, 0.9
SAME_MAIN_FACTOR = 1.2
AUTHOR_LIKE, AUTHOR_LIKE_FACTOR = 0.8, 1.2
AUTHOR_UNLIKE, AUTHOR_UNLIKE_FACTOR = 0.4, 0.7
PREFIX_BONUS, AUTHOR_BONUS, AUTHOR_EXACT = 1.10, 1.15, 0.95
AUTHOR_MISMATCH = 0.5
HIGH_PRICE = 50
PRICE = r"\$?([\d,]+\.?\d*)"
# (text in the wanted title, text in the listing title, least score)
FLOOR_RULES = (
    ("apollo murders", "apollo murders", 92),
    ("there are places in the world", "there are places in the world", 92),
)


def check_weights(weights: Mapping[str, float]) -> None:
    """Weights must name the four measures, lie between 0 and 1 and sum to one.

    They hold for titles of up to 50 characters; longer ones always take ``LONG_WEIGHTS``.
    """
    named = set(weights) == set(WEIGHTS) and all(0 <= w <= 1 for w in weights.values())
    if not named or abs(sum(weights.values()) - 1) > 0.001:
        raise ValueError(f"weights must give {', '.join(WEIGHTS)}, each from 0 to 1, and sum to 1: {dict(weights)}")


def _weighted_sum(weights: Mapping[str, float], is_long: Column) -> Column:
    total = None
    for name in WEIGHTS:
        weight = F.when(is_long, float(LONG_WEIGHTS[name])).otherwise(float(weights[name]))
        part = F.col(name) * weight
        total = part if total is None else total + part
    return total


def _words(text: str) -> Column:
    return F.array_distinct(F.split(F.trim(text), " "))


def _base_score(weights: Mapping[str, float], author_score: str | None) -> Column:
    """Weighted measures and, in this order, the factors of a pair."""
    q_length, l_length = F.length("q_text"), F.length("l_text")
    gap, total = F.abs(q_length - l_length), q_length + l_length
    q_words = _words("q_text")
    few = (F.size(q_words) <= FEW_WORDS) & (
        F.size(F.array_intersect(q_words, _words("l_text"))) * 2 < F.size(q_words)
    )
    score = _weighted_sum(weights, (q_length > LONG_TITLE) | (l_length > LONG_TITLE))
    factors = [
        F.when(few, FEW_WORDS_FACTOR),
        F.when((total > LONG_SUM) & (gap > LONG_GAP), LONG_GAP_FACTOR).when(
            (total <= LONG_SUM) & (gap > SHORT_GAP), SHORT_GAP_FACTOR
        ),
        F.when(F.col("q_main") == F.col("l_main"), SAME_MAIN_FACTOR),
    ]
    if author_score:
        similarity = F.col(author_score) / 100.0
        factors.append(
            F.when(similarity > AUTHOR_LIKE, AUTHOR_LIKE_FACTOR).when(
                similarity < AUTHOR_UNLIKE, AUTHOR_UNLIKE_FACTOR
            )
        )
    for factor in factors:
        score = score * factor.otherwise(1.0)
    return score


def to_percent(score: Column) -> Column:
    return F.least(F.floor(score).cast("int"), F.lit(100))


def with_measures(pairs: DataFrame) -> DataFrame:
    """Add the three measures that cost one pass over a pair, and ``most_partial``, the most the window measure can be."""
    q, l = F.col("q_text"), F.col("l_text")
    q_sorted, l_sorted = F.col("q_sorted"), F.col("l_sorted")

    def common(a: Column, b: Column) -> Column:
        return lcs_length(F.when(a != b, a), F.when(a != b, b))

    lengths = {"_lcs": common(q, l), "_lcs_sorted": common(q_sorted, l_sorted)}
    return (
        with_token_set_ratio(pairs, "q_sorted", "l_sorted", "token_set_ratio", lengths)
        .withColumns(
            {
                "ratio": ratio_of(q, l, F.col("_lcs")),
                "token_sort_ratio": ratio_of(q_sorted, l_sorted, F.col("_lcs_sorted")),
                "most_partial": most_partial(q, l, F.col("_lcs")),
            }
        )
        .drop(*lengths)
    )


def with_bound(
    pairs: DataFrame, weights: Mapping[str, float] = WEIGHTS, author_score: str | None = None
) -> DataFrame:
    """Add all measures but the window one, and ``bound``, the score with ``most_partial`` in its place.

    The score grows with every measure and is computed by the same steps, so it never exceeds ``bound``.
    """
    check_weights(weights)
    perfect = with_measures(pairs).withColumnRenamed("most_partial", "partial_ratio")
    return perfect.withColumn("bound", _base_score(weights, author_score)).drop("partial_ratio")


def _with_base_score(bounded: DataFrame, weights: Mapping[str, float], author_score: str | None) -> DataFrame:
    return bounded.withColumn(
        "partial_ratio", partial_ratio(F.col("q_text"), F.col("l_text"))
    ).withColumn("base_score", _base_score(weights, author_score))


def score_pairs(
    pairs: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    need: int = 0,
    keep_all: Column | None = None,
    author_score: str | None = None,
    key: str | None = None,
) -> DataFrame:
    """Add the four measures and ``base_score`` to variation pairs.

    Needs ``q_text, q_sorted, q_main`` and the same with ``l_``. With ``need`` > 0, pairs whose
    ``bound`` stays below it are dropped before the window measure (the expensive one) is computed,
    except where ``keep_all`` holds. With ``key``, pairs are also dropped that a pair beside them with the same key
    beats; the best ones of every key stay, and rows of a key that come together spare most windows.
    """
    bounded = with_bound(pairs, weights, author_score)
    if need > 0:
        keep = F.floor("bound") >= need
        bounded = bounded.where(keep if keep_all is None else keep | keep_all)
    if key is None:
        return _with_base_score(bounded, weights, author_score).drop("bound")
    for name, measure in (("_least", 0), ("_most", 100)):
        bounded = bounded.withColumn("partial_ratio", F.lit(measure)).withColumn(name, _base_score(weights, author_score))
    scores = (F.col(c) for c in ("_least", "_most", "bound"))
    left = with_winning_partial(bounded.drop("partial_ratio"), key, "q_text", "l_text", *scores)
    return left.withColumn("base_score", _base_score(weights, author_score)).drop("_least", "_most", "bound")


def contenders(
    bounded: DataFrame,
    key: str,
    weights: Mapping[str, float] = WEIGHTS,
    author_score: str | None = None,
    **skew: int,
) -> DataFrame:
    """The pairs of a stored ``with_bound`` table that can still win or tie for their ``key``.

    The pair with the highest bound of every key is scored in full; another pair stays only if its own
    bound reaches that score. A key may own any share of the pairs: the first step is a partial
    aggregate, the second ``lookup_join``.
    """
    columns = F.struct(*(F.col(c) for c in bounded.columns))
    favourites = bounded.groupBy(key).agg(F.max_by(columns, "bound").alias("_pair"), F.count("*").alias("n"))
    first = written(
        _with_base_score(favourites.select("n", "_pair.*"), weights, author_score).select(
            key, "n", F.col("base_score").alias("_reached")
        ),
        "favourites",
    )
    spread = F.xxhash64("listing_id", "l_variation", "q_variation")
    met = lookup_join(bounded, first.drop("n"), key, spread, counts=first.select(key, "n"), **skew)
    return met.where(F.col("bound") >= F.col("_reached")).drop("_reached")


def best_pairs(
    pairs: DataFrame,
    key: str,
    weights: Mapping[str, float] = WEIGHTS,
    author_score: str | None = None,
    **skew: int,
) -> DataFrame:
    """``best_per_query`` of ``score_pairs``, with the window measure of ``contenders`` only."""
    bounded = written(with_bound(pairs, weights, author_score).where(F.col("bound") > 0), "bounds")
    left = contenders(bounded, key, weights, author_score, **skew)
    return best_per_query(_with_base_score(left, weights, author_score), key)


def least_base_percent(threshold: int) -> int:
    """Smallest base percentage that reaches ``threshold`` with both bonuses."""
    for percent in range(101):
        if min(int(min(int(percent * PREFIX_BONUS), 100) * AUTHOR_BONUS), 100) >= threshold:
            return percent
    return 101


def least_shared_percent(need: float, weights: Mapping[str, float] = WEIGHTS) -> int:
    """Least part of the lighter title, in percent, that common words must make up for a score of ``need``.

    A window can match perfectly, so the other measures average ``t`` at least, by the weights of short or of
    long titles. Where spelling does not reach ``t``, the token-set measure of the common words has to,
    which is ``200 * common / (common + title)``; measures are rounded to whole numbers.
    """
    least = 100.0
    for used in (weights, LONG_WEIGHTS):
        window = used["partial_ratio"]
        t = (need - 100 * window) / max(1 - window, 1e-9) - 0.5
        least = min(least, 100 * t / (200 - t))
    return max(1, int(least))


def token_bound(
    weights: Mapping[str, float], q_text: np.ndarray, l_text: np.ndarray, q_sorted: np.ndarray, l_sorted: np.ndarray,
    q_set: np.ndarray, l_set: np.ndarray, shared: np.ndarray,
) -> np.ndarray:
    """Highest weighted sum, with its length penalty, of pairs of titles with these lengths.

    Lengths are those of the texts, of the sorted words, of the distinct words and of the distinct words in
    common, each joined by blanks. No common subsequence is longer than the shorter side, and the
    token-set measure is one of the common words against a side, or of the two sides.
    """
    most = lambda a, b: np.minimum(100.0, np.minimum(a, b) * 200.0 / np.maximum(a + b, 1) + 0.5)
    parts = {
        "ratio": most(q_text, l_text),
        "partial_ratio": 100.0,
        "token_sort_ratio": most(q_sorted, l_sorted),
        "token_set_ratio": np.maximum(most(shared, np.minimum(q_set, l_set)), most(q_set, l_set)),
    }
    is_long = (q_text > LONG_TITLE) | (l_text > LONG_TITLE)
    total = 0.0
    for name in WEIGHTS:
        total = total + parts[name] * np.where(is_long, float(LONG_WEIGHTS[name]), float(weights[name]))
    gap, both = np.abs(q_text - l_text), q_text + l_text
    long_gap, short_gap = (both > LONG_SUM) & (gap > LONG_GAP), (both <= LONG_SUM) & (gap > SHORT_GAP)
    penalty = np.where(long_gap, LONG_GAP_FACTOR, np.where(short_gap, SHORT_GAP_FACTOR, 1.0))
    return total * penalty + 1e-9


def best_per_query(scored: DataFrame, *keys: str) -> DataFrame:
    """Highest positive base score per key.

    Ties go to the earliest query variation, then listing, then listing variation.
    """
    earliest = [(-F.col(c)).alias(c) for c in ("q_variation", "listing_id", "l_variation")]
    best = F.max(F.struct(F.col("base_score"), *earliest))
    return (
        scored.where(F.col("base_score") > 0)
        .groupBy(*keys)
        .agg(best.alias("_best"))
        .select(*keys, "_best.base_score", (-F.col("_best.listing_id")).alias("listing_id"))
    )


def with_author_score(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Token-set similarity of two author columns; NULL unless both are given."""
    both = F.col(left).isNotNull() & F.col(right).isNotNull()
    tokens = {
        "_left_author": F.when(both, sorted_tokens(F.lower(left))),
        "_right_author": F.when(both, sorted_tokens(F.lower(right))),
    }
    scored = with_token_set_ratio(df.withColumns(tokens), *tokens, out)
    return scored.withColumn(out, F.when(F.col("_left_author").isNotNull(), F.col(out))).drop(
        *tokens
    )


def with_bonuses(df: DataFrame) -> DataFrame:
    """``score``, ``match_type`` and ``bonuses`` of fuzzy matches.

    Needs ``base_score``, ``author_score`` and ``q_isbn_norm``, ``l_isbn_norm``.
    """
    prefix = same_prefix(F.col("q_isbn_norm"), F.col("l_isbn_norm"))
    author = F.coalesce(F.col("author_score") / 100.0 >= AUTHOR_EXACT, F.lit(False))
    score = to_percent(F.col("base_score"))
    for earned, factor in ((prefix, PREFIX_BONUS), (author, AUTHOR_BONUS)):
        score = to_percent(score * F.when(earned, factor).otherwise(1.0))
    return (
        df.withColumn("score", score)
        .withColumn(
            "match_type",
            F.when(prefix & author, "fuzzy_isbn_author")
            .when(prefix, "fuzzy_isbn_partial")
            .when(author, "fuzzy_author_exact")
            .otherwise("fuzzy"),
        )
        .withColumn(
            "bonuses",
            F.array_compact(
                F.array(F.when(prefix, F.lit("isbn_partial")), F.when(author, F.lit("author_exact")))
            ),
        )
    )


def applies_to_query(rules: Sequence[tuple[str, str, int]], title: str) -> Column:
    """True for titles that a floor rule names."""
    hit = F.lit(False)
    for fragment, _, _ in rules:
        hit = hit | F.contains(F.lower(title), F.lit(fragment))
    return hit


def raise_to_floor(
    score: Column, rules: Sequence[tuple[str, str, int]], query: str, listing: str
) -> Column:
    """Lift the score where both titles hold the fragments of a rule."""
    for in_query, in_listing, floor in rules:
        hit = F.contains(F.lower(query), F.lit(in_query)) & F.contains(
            F.lower(listing), F.lit(in_listing)
        )
        score = F.greatest(score, F.when(hit, floor))  # ignores NULL
    return score


def author_agrees(author_score: Column) -> Column:
    """Author gate: passes unless both authors are known and too different."""
    return F.coalesce(author_score / 100.0 >= AUTHOR_MISMATCH, F.lit(True))


def author_band(author_score: Column) -> Column:
    """How the author similarity is judged."""
    similarity = author_score / 100.0
    return (
        F.when(similarity >= AUTHOR_EXACT, "exact")
        .when(similarity > AUTHOR_LIKE, "boost")
        .when(similarity < AUTHOR_UNLIKE, "penalise")
        .when(similarity < AUTHOR_MISMATCH, "mismatch")
        .when(similarity.isNotNull(), "neutral")
    )


def price_value(price: Column) -> Column:
    """First number in a price text."""
    return F.replace(F.regexp_extract(price, PRICE, 1), F.lit(","), F.lit("")).try_cast("double")


def is_high_price(value: Column) -> Column:
    return F.coalesce(value > HIGH_PRICE, F.lit(False))
