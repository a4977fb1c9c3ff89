"""Mixing sources to target weights by weighted fair queueing.

Sources share ``SHARE`` times all words by weight, but none may give more than ``REPEATS`` times its
own words; what it cannot give is shared again by weight. Every source is a queue of its documents,
shuffled by a hash, once per repeat. A document's virtual finish time is the number of words of its
source up to and including it, divided by the source's target. All queues together are range-sorted
by finish time and cut where the words reach the total budget. So every source is served in
proportion to its target, to within one document.

The size of a document is its number of words; NULL text has none. Documents of NULL source form a
source of their own, last in the order of sources. Words and targets are counted over all rows.
Documents without words are never taken. Rows that repeat a ``doc_id``, and rows without one, are
documents of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelflink.llm.common import WORD, Scratch, running_total

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """source, source_size, target of each source of ``sizes`` (source, size).

    Sorted by limit over weight, the level at which the budget is used up follows from running
    sums; the targets are those of resharing the excess until no source is above its limit.
    ``share`` counts in thousandths.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on, so the windows below need no partition.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("rank", rank).withColumns(
        {
            "weight": F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")),
            "limit": (F.col("source_size") * repeats).cast("double"),
        }
    )
    before = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    all_rows = Window.partitionBy()
    zero = F.lit(0.0)
    # In thousandths of a word, whole numbers kept as doubles: exact below 2^53, never overflowing.
    sums = ranked.withColumns(
        {
            "left": F.sum("source_size").over(all_rows).cast("double") * round(share * 1000)
            - F.coalesce(F.sum("limit").over(before), zero) * 1000.0,
            "rest": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), zero),
        }
    ).withColumn("above", F.col("left") * F.col("weight") >= F.col("limit") * 1000.0 * F.col("rest"))
    level = F.min(
        F.when(~F.col("above"), F.struct(F.col("limit") / F.col("weight"), "rank", "left", "rest"))
    ).over(all_rows)
    shared = F.col("weight") * F.col("level.left") / (F.col("level.rest") * 1000.0)
    target = F.when(F.col("above"), F.col("limit")).otherwise(shared)
    return sums.withColumn("level", level).select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """doc_id, mark (hash of the text), size, source_size, target, copies, taken: one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0))
    sizes = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("mark"))
    sizes = scratch.put(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = source_targets(sizes, weights, share, repeats).withColumn(
        "start", F.sum("source_size").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1))
    )
    targets = scratch.put(
        targets.withColumn("start", F.coalesce("start", F.lit(0)) * repeats).coalesce(1), "targets"
    )
    # The few rows of ``targets`` may be as many as there are sources; Spark decides on a broadcast.
    known = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    turn = F.explode(F.array(*map(F.lit, range(repeats))))
    place = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "turn"))
    queued = known.where("size > 0").withColumn("turn", turn).withColumn("place", place)
    queued = queued.select("row", "doc_id", "source", "size", "target", "start", "turn", "place")
    queues = running_total(scratch, queued, "size", ["source", "turn", "place", "doc_id", "row"], "served")
    finish = (F.col("served") - F.col("start")).cast("double") / F.col("target")
    timed = queues.select("row", "doc_id", "size", "turn", finish.alias("finish"))
    ordered = running_total(scratch, timed, "size", ["finish", "doc_id", "turn", "row"], "words")
    words = sizes.agg(F.sum("size")).first()[0] or 0
    taken = ordered.where(F.col("words") <= words * round(share * 1000) // 1000)
    copies = taken.groupBy("row").agg(F.count("*").alias("copies"))
    out = known.join(copies, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.select(
        "doc_id", "mark", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a document taken twice is two rows; same columns.

    Rows that repeat both ``doc_id`` and text all get the largest number of copies among them.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    copies = mix(docs, **options).where("copies > 0").groupBy("doc_id", "mark").agg(F.max("copies").alias("_copies"))
    copies = scratch.put(copies, "copies")
    # Whole rows in one column, so no name can clash.
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("mark"))
    same = rows["doc_id"].eqNullSafe(copies["doc_id"]) & (rows["mark"] == copies["mark"])
    joined = rows.join(copies.hint("shuffle_hash"), same).select("row", "_copies")
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return repeated.select("row.*")
