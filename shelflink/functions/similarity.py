"""Title similarity measures on a 0..100 scale.

Everything except two kernels is built-in Spark expressions. The kernels (length of the longest
common subsequence, and its best value over the windows of the longer text) run as Arrow-batched
pandas UDFs that work on whole batches with numpy: as built-in higher-order functions they are
interpreted per character, which measured more than ten times slower.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_BITS = 64
CELLS_PER_BLOCK = 1 << 16
MASKS_PER_BLOCK = 1 << 22
#: A block pays for texts of up to so many machine words, with so many rows for each word.
WORDS_IN_BLOCK, ROWS_A_WORD = 8, 100
NEAR_PERFECT = 0.995


# --- kernels -----------------------------------------------------------------------------------


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def _code_matrix(texts: list[str], fill: int) -> np.ndarray:
    """Code points of the texts, one column each, padded at the bottom with ``fill``."""
    lengths = _lengths(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    out = np.full((len(texts), int(lengths.max(initial=0))), fill, dtype=np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = codes
    return np.ascontiguousarray(out.T)


def _blocks(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of an ascending ``sizes`` whose padded block stays below ``limit`` cells."""
    start = 0
    while start < len(sizes):
        stop = start + 1
        # A block is as wide as its last (largest) row.
        while stop < len(sizes) and (stop + 1 - start) * sizes[stop] <= limit:
            stop += 1
        yield slice(start, stop)
        start = stop


def _lcs_words(short: list[str], long: list[str]) -> np.ndarray:
    """LCS lengths of a block of pairs (bit-parallel, Hyyrö 2004).

    Texts longer than a machine word take several, lowest first, with a carry from each to the next.
    """
    s, t = _code_matrix(short, -1) + 1, _code_matrix(long, -1) + 1
    used = np.zeros(max(s.max(initial=0), t.max(initial=0)) + 1, dtype=bool)
    used[s.ravel()] = used[t.ravel()] = used[0] = True
    dense = np.cumsum(used) - 1
    count, words = len(short), -(-len(s) // WORD_BITS)
    if dense[-1] * words * count > MASKS_PER_BLOCK and count > 1:  # many different characters
        half = count // 2
        parts = (_lcs_words(short[k], long[k]) for k in (slice(half), slice(half, None)))
        return np.concatenate(list(parts))
    rows = np.arange(count)
    masks = np.zeros((words, (int(dense[-1]) + 1) * count), dtype=np.uint64)
    for i, column in enumerate(dense[s]):
        masks[i // WORD_BITS, column * count + rows] |= np.uint64(1 << i % WORD_BITS)
    masks[:, :count] = 0  # padding of both sides
    state = np.full((words, count), np.uint64(0xFFFFFFFFFFFFFFFF))
    for column in dense[t]:
        hits = masks.take(column * count + rows, axis=1)
        hits &= state
        carry = None
        for word, hit in zip(state, hits):
            total = word + hit
            if carry is not None:
                total += carry
            if words > 1:
                # The sum, at most one carry included, passed the top of the word.
                carry = ((word & hit) | ((word | hit) & ~total)) >> np.uint64(WORD_BITS - 1)
            word -= hit
            word |= total
    return words * WORD_BITS - np.bitwise_count(state).astype(np.int64).sum(axis=0)


def _lcs_integers(short: str, long: str) -> int:
    """The same recurrence on Python integers, whose every step is one pass over many words."""
    full = (1 << len(short)) - 1
    masks: dict[str, int] = {}
    for i, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    state = full
    for ch in long:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(short) - state.bit_count()


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right)]
    out = np.zeros(len(pairs), dtype=np.int64)
    short, long = _lengths([a for a, _ in pairs]), _lengths([b for _, b in pairs])
    # Pairs of equally many machine words together; a block is as wide as its longest text.
    words = -(-short // WORD_BITS)
    todo = np.lexsort((long, words))
    for group in np.split(todo, np.flatnonzero(np.diff(words[todo])) + 1):
        many = words[group[0]] if len(group) else 0
        if many == 0:
            continue
        if many > WORDS_IN_BLOCK or 1 < many and len(group) < ROWS_A_WORD * many:
            out[group] = [_lcs_integers(*pairs[k]) for k in group]
            continue
        for block in _blocks(long[group], 4 * CELLS_PER_BLOCK):
            rows = group[block]
            out[rows] = _lcs_words([pairs[k][0] for k in rows], [pairs[k][1] for k in rows])
    return out


def _window_lcs(short: list[str], long: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """LCS of ``short`` with every window ``long[i : i + len(short)]``, and the window widths.

    Semi-local LCS by combing strands through the alignment grid (Tiskin 2008), one anti-diagonal
    of the whole block at a time: all windows together cost one pass over the grid.
    """
    m_each, n_each = _lengths(short), _lengths(long)
    s, t = _code_matrix(short, -1)[::-1].copy(), _code_matrix(long, -2)
    m, n, count = len(s), len(t), len(short)
    strand = np.int16 if m + n < 1 << 15 else np.int32
    across = np.repeat(np.arange(m, dtype=strand)[:, None], count, axis=1)
    down = np.repeat(np.arange(m, m + n, dtype=strand)[:, None], count, axis=1)
    for diagonal in range(m + n - 1):
        shift = diagonal - m + 1
        lo, hi = max(0, -shift), min(m, n - shift)
        h, v = across[lo:hi], down[lo + shift : hi + shift]
        # Equal characters make the strands turn; others cross, but only once.
        h_next = np.minimum(h, v)
        np.copyto(h_next, v, where=s[lo:hi] == t[lo + shift : hi + shift])
        v += h
        v -= h_next
        h[:] = h_next
    # A strand that enters above column a and leaves below column e costs one character in every
    # window that holds both columns.
    start = np.arange(n)[:, None]
    entry = down.astype(np.int64) - m
    first = np.maximum(start - m_each + 1, 0)
    lost = (entry >= first) & (start < n_each)
    position, pair = np.nonzero(lost)
    change = np.zeros((n + 1, count), dtype=np.int64)
    np.add.at(change, (first[position, pair], pair), 1)
    np.add.at(change, (entry[position, pair] + 1, pair), -1)
    width = np.clip(n_each - start, 0, m_each)
    return width - np.cumsum(change, axis=0)[:n], width


def best_window_ratios(short: list[str], long: list[str]) -> np.ndarray:
    """Best similarity (0..1) of ``short`` with a window of ``long`` of the same length."""
    out = np.zeros(len(short))
    m, n = _lengths(short), _lengths(long)
    todo = np.flatnonzero(m > 0)
    todo = todo[np.lexsort((m[todo], n[todo]))]
    for block in _blocks(n[todo], CELLS_PER_BLOCK):
        rows = todo[block]
        lcs, width = _window_lcs([short[k] for k in rows], [long[k] for k in rows])
        # Windows that begin beyond the end of a padded text have no width.
        ratios = np.where(width > 0, 2.0 * lcs / (m[rows] + width), 0.0)
        out[rows] = ratios.max(axis=0)
    return out


def _where_given(kernel, left: pd.Series, right: pd.Series, dtype: str) -> pd.Series:
    """Kernel results for the pairs with both sides, 0 elsewhere."""
    given = (left.notna() & right.notna()).to_numpy()
    out = np.zeros(len(left), dtype=dtype)
    out[given] = kernel(left[given].tolist(), right[given].tolist())
    return pd.Series(out)


def _lcs_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    return _where_given(lcs_lengths, left, right, "int32")


def _window_batch(short: pd.Series, long: pd.Series) -> pd.Series:
    return _where_given(best_window_ratios, short, long, "float64")


def _winning_batch(
    key: pd.Series, least: pd.Series, most: pd.Series, bound: pd.Series, fixed: pd.Series, short: pd.Series, long: pd.Series
) -> pd.Series:
    """``best_window_ratios`` of the pairs that can still win or tie for their key among those of the batch, NULL for the others.

    The score of a pair rises in proportion to its window measure, from ``least`` to ``most``, and is no higher than ``bound``;
    pairs whose measure is ``fixed`` need no window. The pair with the highest bound of every key goes first.
    """
    keys = pd.factorize(key, use_na_sentinel=False)[0]
    least, rise, bound = least.to_numpy(), (most - least).to_numpy() / 100, bound.to_numpy()
    known = fixed.notna().to_numpy()
    reached = np.full(keys.max(initial=-1) + 1, -np.inf)
    np.maximum.at(reached, keys[known], (least + rise * fixed.to_numpy())[known])
    out = np.full(len(keys), np.nan)
    left = np.flatnonzero(~known)
    left = left[np.lexsort((-bound[left], keys[left]))]
    first = np.diff(keys[left], prepend=-1) != 0
    for rows in (left[first], left[~first]):
        # Scores are added up in another order here: a little less never counts as less.
        rows = rows[bound[rows] >= reached[keys[rows]] - 1e-6]
        out[rows] = best_window_ratios(short.iloc[rows].tolist(), long.iloc[rows].tolist())
        measure = np.where(out[rows] > NEAR_PERFECT, 100, np.rint(100 * out[rows]))
        np.maximum.at(reached, keys[rows], least[rows] + rise[rows] * measure)
    return pd.Series(out)


# Declared non-deterministic so that the optimizer evaluates each kernel once: it would otherwise
# push filters on the results below the projection and run the kernel there a second time.
_lcs_udf = F.pandas_udf(_lcs_batch, T.IntegerType()).asNondeterministic()
_window_udf = F.pandas_udf(_window_batch, T.DoubleType()).asNondeterministic()
_winning_udf = F.pandas_udf(_winning_batch, T.DoubleType()).asNondeterministic()


# --- measures as columns -----------------------------------------------------------------------


def clean_for_tokens(text: Column) -> Column:
    """Lower-cased text in which runs of anything but letters, numbers and _ are one blank.

    Latin-1 supplement characters are deleted first, as the measure defines it.
    """
    plain = F.octet_length(text) == F.length(text)
    ascii_ish = F.when(plain, text).otherwise(F.regexp_replace(text, r"[\x80-\xFF]", ""))
    return F.trim(F.lower(F.regexp_replace(ascii_ish, r"[^\p{L}\p{N}_]+", " ")))


def sorted_tokens(text: Column) -> Column:
    """Cleaned tokens in code point order, repeats kept, joined by blanks."""
    return F.array_join(F.sort_array(F.split(clean_for_tokens(text), " ")), " ")


def token_set(sorted_text: Column) -> Column:
    """Distinct tokens of a ``sorted_tokens`` text; NULL when there is none."""
    return F.array_distinct(F.split(F.nullif(sorted_text, F.lit("")), " "))


def _percent(common: Column, total: Column) -> Column:
    """``100 * (2 * common / total)`` rounded half to even."""
    return F.rint(F.lit(100.0) * (common * 2 / F.greatest(total, F.lit(1)))).cast("int")


def lcs_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence; 0 when a side is NULL."""
    return _lcs_udf(left, right)


def ratio(left: Column, right: Column) -> Column:
    """Similarity by longest common subsequence; NULL or one empty side scores 0.

    On ``sorted_tokens`` texts this is the token-sort measure.
    """
    differ = left != right
    return ratio_of(left, right, lcs_length(F.when(differ, left), F.when(differ, right)))


def ratio_of(left: Column, right: Column, lcs: Column) -> Column:
    """``ratio`` when the length of the longest common subsequence is known (any value for equal texts)."""
    return (
        F.when(left.isNull() | right.isNull(), 0)
        .when(left == right, 100)
        .otherwise(_percent(lcs, F.length(left) + F.length(right)))
    )


def most_partial(left: Column, right: Column, lcs: Column) -> Column:
    """Upper bound of ``partial_ratio`` from the longest common subsequence of the whole texts.

    A window shares no longer subsequence than the whole text, nor one longer than itself; the ratio
    ``2 * common / (short + width)`` is then largest for a window of just ``lcs`` characters.
    """
    short = F.least(F.length(left), F.length(right))
    most = lcs * 2.0 / F.greatest(short + lcs, F.lit(1))
    return (
        F.when(left.isNull() | right.isNull(), 0)
        .when((left == right) | (most > NEAR_PERFECT), 100)
        .otherwise(F.rint(F.lit(100.0) * most).cast("int"))
    )


def partial_ratio(left: Column, right: Column) -> Column:
    """Best ``ratio`` of the shorter text with a window of the longer one.

    Every start position counts, also those whose window is cut off by the end of the longer text.
    The left text is the shorter one when both have the same length.
    """
    fixed, short, long = _window_sides(left, right)
    return F.coalesce(fixed, _window_percent(_window_udf(short, long)))


def _window_sides(left: Column, right: Column) -> tuple[Column, Column, Column]:
    """The window measure where it needs no window, and both texts, the shorter one first, where it does."""
    left_first = F.length(left) <= F.length(right)
    short = F.when(left_first, left).otherwise(right)
    long = F.when(left_first, right).otherwise(left)
    fixed = (
        F.when(left.isNull() | right.isNull(), 0)
        .when(left == right, 100)
        .when(short == "", 0)
        .when(F.contains(long, short), 100)
    )
    return fixed, F.when(fixed.isNull(), short), F.when(fixed.isNull(), long)


def _window_percent(best: Column) -> Column:
    return F.when(best > NEAR_PERFECT, 100).otherwise(F.rint(F.lit(100.0) * best).cast("int"))


def with_winning_partial(pairs: DataFrame, key: str, left: str, right: str, least: Column, most: Column, bound: Column) -> DataFrame:
    """Add ``partial_ratio``, without pairs that another one of their ``key`` beats whatever it is.

    The scores ``least`` and ``most`` are those with measures of 0 and 100, and ``bound`` is one that the pair cannot
    exceed. Only pairs that are near each other meet: this prunes, what is left is still to be compared.
    """
    fixed, short, long = _window_sides(F.col(left), F.col(right))
    found = pairs.withColumns({"_fixed": fixed, "_short": short, "_long": long})
    best = _winning_udf(F.col(key), least, most, bound, F.col("_fixed").cast("double"), F.col("_short"), F.col("_long"))
    return (
        found.withColumn("_best", best)
        .where(F.col("_fixed").isNotNull() | F.col("_best").isNotNull())
        .withColumn("partial_ratio", F.coalesce("_fixed", _window_percent(F.col("_best"))))
        .drop("_fixed", "_short", "_long", "_best")
    )


def with_token_set_ratio(
    df: DataFrame, left: str, right: str, out: str, lengths: Mapping[str, Column] | None = None
) -> DataFrame:
    """Add the token-set measure of two ``sorted_tokens`` columns.

    Best of: shared tokens against either side, and the two sides against each other. All three
    begin with the shared tokens, so only the remainders go through the kernel. ``lengths`` are further
    ``lcs_length`` columns to add: computed side by side, they share one Python worker a task.
    """
    a, b = token_set(F.col(left)), token_set(F.col(right))
    split = {
        "_shared": F.length(F.array_join(F.array_intersect(a, b), " ")),
        "_rest_a": F.array_join(F.array_except(a, b), " "),
        "_rest_b": F.array_join(F.array_except(b, a), " "),
    }
    df = df.withColumns(split)
    both = (F.col("_rest_a") != "") & (F.col("_rest_b") != "")
    of_rests = lcs_length(F.when(both, F.col("_rest_a")), F.when(both, F.col("_rest_b")))
    df = df.withColumns({"_lcs_rests": of_rests, **(lengths or {})})
    lcs = F.col("_lcs_rests")
    shared, len_a, len_b = F.col("_shared"), F.length("_rest_a"), F.length("_rest_b")
    gap_a, gap_b = ((F.least(shared, n) > 0).cast("int") for n in (len_a, len_b))
    side_a, side_b = shared + gap_a + len_a, shared + gap_b + len_b
    common = shared + F.least(gap_a, gap_b) + lcs
    empty = (F.col(left) == "") | (F.col(right) == "")
    score = (
        F.when(F.col(left).isNull() | F.col(right).isNull() | empty, 0)
        .when((shared > 0) & ((len_a == 0) | (len_b == 0)), 100)
        .otherwise(
            F.greatest(
                F.when(shared > 0, _percent(shared, shared + side_a)).otherwise(0),
                F.when(shared > 0, _percent(shared, shared + side_b)).otherwise(0),
                _percent(common, side_a + side_b),
            )
        )
    )
    return df.withColumn(out, score).drop("_lcs_rests", *split)
