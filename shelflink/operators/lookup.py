"""Equi-join of many rows with a lookup table, safe against hot keys.

A key may hold a third of all rows. Hot keys are found by counting; their rows are spread over
as many buckets as there are times ``hot_rows`` rows, and the few lookup rows of those keys are
repeated once per bucket; all other keys join as usual. Nothing is dropped and nothing large is broadcast: the only broadcast is the list of
hot key hashes, twelve bytes each with their buckets and at most ``HOT_SHARE`` of them (12 MB),
because each hot key owns at least one part in ``HOT_SHARE`` of the counted rows; up to ``HOT_SHARE`` times ``hot_rows`` (10^12) rows,
no key above ``hot_rows`` stays whole. A key that shares a hot key's hash is merely
spread as well, on both sides alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1_000_000
HOT_ROWS = 1_000_000
NULL_BUCKETS = 4096


def hot_keys(counts: DataFrame, key: str, n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of keys that own ``hot_rows`` rows or more and one part in ``HOT_SHARE`` of all.

    With ``_buckets``, the number of buckets that keeps each near ``hot_rows`` rows.
    """
    total = counts.agg(F.sum(n)).scalar()
    hot = counts.where((F.col(n) >= hot_rows) & (F.col(n) * HOT_SHARE >= total))
    buckets = F.ceil(F.max(n) / F.lit(hot_rows)).cast("int")
    return hot.groupBy(F.xxhash64(key).alias("_hash")).agg(buckets.alias("_buckets"))


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: Column,
    how: str = "inner",
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` with ``lookup`` on ``key``; the lookup has few rows per key.

    ``spread`` is a stable column of ``rows`` (an id) that decides the task of a hot row, so a
    recomputed task sends every row to the same place. ``counts(key, n)`` may be given when the
    caller already knows how many rows each key has. ``how`` is ``inner`` or ``left``.
    """
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hot = F.broadcast(hot_keys(counts, key, hot_rows=hot_rows))
    hashed = {"_hash": F.xxhash64(key)}
    # NULL keys never match; spreading them keeps a left join from sending them to one task.
    buckets = F.when(F.col(key).isNull(), NULL_BUCKETS).otherwise(F.coalesce("_buckets", F.lit(1)))
    salted = rows.withColumns(hashed).join(hot, "_hash", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), buckets).cast("int")
    )
    repeats = F.coalesce(F.col("_buckets") - 1, F.lit(0))
    repeated = lookup.withColumns(hashed).join(hot, "_hash", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), repeats))
    )
    helpers = ("_buckets", "_hash")
    return salted.drop(*helpers).join(repeated.drop(*helpers), [key, "_salt"], how).drop("_salt")
