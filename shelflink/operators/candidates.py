"""Which listings an entry is compared with.

Without a result page per entry, candidates come from the titles: two title variations are
candidates when the words they share carry at least ``min_overlap`` percent of the word weight of
either side. A word's weight is the bit length of (number of listing variations / number of listing
variations with the word), so rare words count most, and whether an entry meets a listing does not
depend on the other entries. A word no listing has weighs as much as one that a single listing has.

The join is complete for that definition. Words are ordered rarest first; a qualifying pair must
share a word inside both sides' *prefix*, the words whose remaining weight (the word itself and all
more frequent ones) still reaches the required share (prefix filtering, Bayardo 2007 / Xiao 2008).
Frequent words therefore hardly ever serve as keys. Titles meet in blocks inside tasks (``blocks``);
no word, pair or partner is cut off.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelflink.functions.similarity import token_set
from shelflink.operators.blocks import BLOCK_ROWS, overlapping, pairs_of_blocks, weighed
from shelflink.operators.lookup import lookup_join
from shelflink.scratch import written

MIN_OVERLAP = 60
#: Words of entries that are looked up together.
CARRIED_WORDS = 2048
#: Text of words that the driver passes on to the tasks, at most.
KNOWN_BYTES = 16 << 20
HOT_WORDS = 10_000
HOT_WORD_LENGTH = 100


def word_weight(variations: int) -> Column:
    """Integer word weight from the number ``df`` of listing variations with the word."""
    return F.length(F.bin(F.floor(F.lit(variations) / F.greatest("df", F.lit(1)))))


def _occurrences(titles: DataFrame) -> DataFrame:
    word = F.explode_outer(token_set(F.col("sorted"))).alias("word")
    return titles.select("id", "variation", word).where(F.col("word").isNotNull())


def _word_counts(queries: DataFrame, listings: DataFrame) -> DataFrame:
    """Occurrences ``n`` of every word on both sides, and ``df`` among the listings."""
    both = _occurrences(queries).select("word", F.lit(0).alias("offered"))
    both = both.union(_occurrences(listings).select("word", F.lit(1)))
    return written(
        both.groupBy("word").agg(F.count("*").alias("n"), F.sum("offered").alias("df")),
        "word-counts",
    )


def _listing_counts(listings: DataFrame) -> DataFrame:
    """Listing variations ``df`` of every word that they have."""
    return written(_occurrences(listings).groupBy("word").agg(F.count("*").alias("df")), "listing-counts")


def _weighted_words(words: DataFrame, counts: DataFrame, variations: int, total: int) -> DataFrame:
    """Attach frequency and weight to every word.

    At most ``HOT_WORDS`` words reach one part in ``HOT_WORDS`` of all occurrences; those of ordinary
    length are looked up by broadcast (a few MB at most) and never shuffled. The rest is joined by
    shuffle.
    """
    is_hot = (F.col("n") * HOT_WORDS >= total) & (F.length("word") <= HOT_WORD_LENGTH)
    hot, cold = F.broadcast(counts.where(is_hot).select("word", "df")), counts.where(~is_hot)
    cold_part = lookup_join(
        words.join(hot, "word", "left_anti"),
        cold.select("word", "df"),
        "word",
        F.col("id"),
        counts=cold.select("word", "n"),
    )
    return (
        words.join(hot, "word")
        .unionByName(cold_part)
        .withColumn("weight", word_weight(variations))
    )


def _word_rows(words: DataFrame) -> DataFrame:
    """One row per variation for ``blocks``: its words, their weights and the ``whole`` weight."""
    weight = F.transform("e.weight", lambda w: F.lpad(F.hex(w), 2, "0"))
    return (
        words.select("id", "variation", F.struct("word", "weight").alias("e"))
        .groupBy("id", "variation")
        .agg(F.sum("e.weight").alias("whole"), F.collect_list("e").alias("e"))
        .select("id", "whole", F.array_join("e.word", " ").alias("words"), F.unhex(F.array_join(weight, "")).alias("weights"))
    )


def _weighed_rows(titles: DataFrame, known: pa.Table, other: int) -> DataFrame:
    """``_word_rows`` with the weights of ``known`` words and one for all others, without a join."""
    words = F.array_join(token_set(F.col("sorted")), " ").alias("words")
    rows = titles.where(F.col("sorted") != "").select("id", words)
    kind = rows.schema["id"].dataType
    types = {"id": to_arrow_type(kind), "whole": pa.int64(), "words": pa.string(), "weights": pa.binary()}
    schema = pa.schema(list(types.items()))

    def run(batches):
        return weighed(batches, known, other, schema)

    return rows.mapInArrow(run, f"id {kind.simpleString()}, whole long, words string, weights binary")


def _known_words(counts: DataFrame, variations: int) -> pa.Table | None:
    """Words of several listing variations with their weights; None if their text has more than ``KNOWN_BYTES``."""
    several = counts.where("df > 1")
    if several.agg(F.coalesce(F.sum(F.octet_length("word") + 1), F.lit(0))).first()[0] > KNOWN_BYTES:
        return None
    return several.select("word", word_weight(variations).alias("weight")).toArrow()


def _crowded_words(q_prefixes: DataFrame, l_prefixes: DataFrame, cell_rows: int) -> DataFrame:
    """Hashes of prefix words with more than ``cell_rows`` rows on a side, and the lines of each side.

    A side without the word has no lines, so the other side's rows of that word meet nobody and go.
    """
    sides = q_prefixes.select("word", F.lit(1).alias("q"), F.lit(0).alias("l")).union(
        l_prefixes.select("word", F.lit(0), F.lit(1))
    )
    counts = sides.groupBy("word").agg(F.sum("q").alias("q"), F.sum("l").alias("l"))
    lines = {f"_{side}_lines": F.ceil(F.max(side) / F.lit(cell_rows)).cast("int") for side in "ql"}
    crowded = counts.where(F.greatest("q", "l") > cell_rows)
    return crowded.groupBy(F.xxhash64("word").alias("_word_hash")).agg(
        *(c.alias(n) for n, c in lines.items()), F.max(F.greatest("q", "l")).alias("n")
    )


def _grid(prefixes: DataFrame, crowded: DataFrame, few: bool, tag: str, other: str, cell_rows: int) -> DataFrame:
    """One side of the prefix join, split into a grid of cells for words many titles share.

    A word with Q lines of entries and L lines of listings is joined in Q x L cells of at most about
    ``cell_rows`` x ``cell_rows``. A row goes to one line of its own side and is repeated for the lines
    of the other side only: a word of one entry and any number of listings repeats nothing.
    """
    carried = ("id", "variation", "rest", "whole", "words")
    hashed = prefixes.withColumn("_word_hash", F.xxhash64("word"))
    lines = crowded.drop("n")
    if few:
        placed = hashed.join(F.broadcast(lines), "_word_hash", "left")
    else:
        placed = lookup_join(
            hashed, lines, "_word_hash", F.col("id"), how="left", counts=crowded.select("_word_hash", "n"), hot_rows=cell_rows
        )
    own_lines, other_lines = (F.coalesce(f"_{side}_lines", F.lit(1)) for side in (tag, other))
    every = F.when(other_lines > 0, F.sequence(F.lit(0), other_lines - 1))
    return (
        placed.withColumn(f"_{tag}_line", F.pmod(F.xxhash64("id"), own_lines).cast("int"))
        .withColumn(f"_{other}_line", F.explode(every))
        .select("word", "_q_line", "_l_line", *(F.col(c).alias(f"{tag}_{c}") for c in carried))
    )


def block_by_title(
    queries: DataFrame,
    listings: DataFrame,
    min_overlap: int = MIN_OVERLAP,
    cell_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Candidate pairs ``(query_id, listing_id)`` from two ``title_table`` tables.

    Both inputs must be tables that are cheap to read again; ``cell_rows`` is the most listings that a task holds.
    Both sides of a pair weigh about the same, so an entry visits only blocks of listings in that range.
    """
    variations = listings.count()
    known = _known_words(_listing_counts(listings), variations)
    if known is not None:
        # All other words are those of one listing variation at most.
        rows = [_weighed_rows(t, known, max(1, variations.bit_length())) for t in (queries, listings)]
    else:
        counts = _word_counts(queries, listings)
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = [_word_rows(_weighted_words(_occurrences(t), counts, variations, total)) for t in (queries, listings)]
    lengths = [F.lit(0).alias(c) for c in ("text_length", "sorted_length")]
    q_rows, l_rows = (written(r.select("*", *lengths), name) for r, name in zip(rows, ("entry-words", "listing-words"), strict=True))
    words = CARRIED_WORDS

    def find(block, entries):
        return overlapping(block, entries, words, min_overlap)

    return pairs_of_blocks(q_rows, l_rows, find, min_overlap, False, cell_rows, span=min_overlap)
