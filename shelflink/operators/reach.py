"""Listing titles that an entry title can reach a needed score with.

Two sources of candidates, both complete for their own definition and independent of what else the
catalogue holds: word frequencies only decide the order in which words are tried.

* ``sharing_titles``: title variations whose common words make up enough of the *lighter* side. A word
  weighs its length and the blank after it, so the share is the part of the shorter text that the
  common words cover, and the token-set measure follows from it: a title contained in a longer one is
  found. How much is enough comes from the needed score (``least_shared_percent``). A pair also
  has to be able to reach that score by its lengths and its common words (``token_bound``).
* ``near_titles``: variations of about equal weight in which ``NEAR_SHARE`` percent of either side are
  words that the other side has, or has in a near spelling. Two words of ``NEAR_LENGTH`` characters or
  more are near when dropping at most one character from each makes them equal (``near_words``): one
  letter wrong, missing, added or moved.

A word weighs its length and the blank after it. Titles meet in blocks inside tasks (``blocks``): an entry looks up its
rarest words, as many as leave less than the share, and in lighter titles all that belong to such words of theirs
(prefix filtering for containment). No word, pair or partner is cut off.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflink.functions.similarity import token_set
from shelflink.operators.blocks import BLOCK_ROWS, near, pairs_of_blocks, sharing
from shelflink.operators.scoring import WEIGHTS, least_shared_percent, token_bound
from shelflink.scratch import written

NEAR_LENGTH = 5
NEAR_SHARE = 80
#: Words of entries that are looked up together, equal ones or near ones, and the greatest weight of a word that is spelled almost alike.
CARRIED_WORDS, CARRIED_KEYS, MOST_WEIGHT = 2048, 1024, 4095


def _counts(queries: DataFrame, listings: DataFrame) -> DataFrame:
    """Occurrences ``n`` of every word, those of entries and of listings."""
    words = [
        t.select(F.explode_outer(token_set(F.col("sorted"))).alias("word"), F.lit(side).alias("offered"))
        for side, t in enumerate((queries, listings))
    ]
    both = words[0].union(words[1]).where("word IS NOT NULL")
    counted = both.groupBy("word").agg(F.count("*").alias("n"), F.sum("offered").alias("offered"))
    return written(counted, "word-counts")


def _rows(titles: DataFrame) -> DataFrame:
    """Titles with words as rows for ``blocks``."""
    words = F.array_join(token_set(F.col("sorted")), " ")
    return titles.where(F.col("sorted") != "").select(
        "id", F.length("text").alias("text_length"), F.length("sorted").alias("sorted_length"),
        (F.length(words) + 1).alias("whole"), words.alias("words"), F.lit(None).cast("binary").alias("weights"),
    )


def sharing_titles(
    queries: DataFrame,
    listings: DataFrame,
    need: float,
    weights: Mapping[str, float] = WEIGHTS,
    cell_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, listing_id)`` of two ``title_table`` tables by common words, see above.

    Both inputs must be tables that are cheap to read again; ``cell_rows`` is the most listings that a task holds.
    """
    percent, words = least_shared_percent(need, weights), CARRIED_WORDS
    given = dict(weights)

    def enough(q, entry, l, listing, shared):
        bound = token_bound(
            given, q.text[entry], l.text[listing], q.sorted[entry], l.sorted[listing],
            q.whole[entry] - 1, l.whole[listing] - 1, shared - 1,
        )
        return np.floor(bound) >= need

    def find(block, entries):
        return sharing(block, entries, words, percent, enough)

    return pairs_of_blocks(_rows(queries), _rows(listings), find, percent, block_rows=cell_rows)


def near_words(counts: DataFrame) -> DataFrame:
    """``(word, near)``: words of entries with different words of listings that are spelled almost alike.

    ``counts(word, n, offered)``. Words equal after dropping at most one character each meet on what is left.
    """
    word, length = F.col("word"), F.length("word")
    drop = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, length))
    left = F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), length), drop)))
    keyed = counts.where(length >= NEAR_LENGTH).select("word", "n", "offered", F.explode(left).alias("left"))
    wanted = keyed.where("n > offered").select("left", "word")
    offered = keyed.where("offered > 0").select("left", F.col("word").alias("near"))
    return wanted.join(offered, "left").where("word <> near").select("word", "near").distinct()


def _spellings(counts: DataFrame) -> DataFrame:
    """Every word of entries that listings spell almost alike, followed by their words, as one text."""
    near = F.array_join(F.collect_list("near"), " ")
    return near_words(counts).groupBy("word").agg(near.alias("near")).select(F.concat_ws(" ", "word", "near").alias("words"))


def near_titles(
    queries: DataFrame,
    listings: DataFrame,
    percent: int = NEAR_SHARE,
    cell_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, listing_id)`` of two ``title_table`` tables by equal and near words, see above.

    A word's weight counts up to ``MOST_WEIGHT``. Both sides of a pair weigh about the same, so an entry visits
    only blocks of listings in that range.
    """
    q_rows, l_rows, counts = title_words(queries, listings)
    spellings = written(_spellings(counts), "spellings")
    words, most_weight = CARRIED_KEYS, MOST_WEIGHT

    def find(block, entries):
        return near(block, entries, words, percent, most_weight)

    return pairs_of_blocks(q_rows, l_rows, find, None, block_rows=cell_rows, span=percent, spellings=spellings)


def title_words(queries: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of both sides for ``blocks``, and the word counts as a written table.

    The rows are not written: who needs the counts alone does not pay for them.
    """
    return _rows(queries), _rows(listings), _counts(queries, listings)


def titles_in_reach(
    queries: DataFrame,
    listings: DataFrame,
    need: float,
    weights: Mapping[str, float] = WEIGHTS,
    cell_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Candidates of both kinds; both inputs must be tables that are cheap to read again."""
    shared = sharing_titles(queries, listings, need, weights, cell_rows)
    return shared.union(near_titles(queries, listings, NEAR_SHARE, cell_rows)).distinct()
