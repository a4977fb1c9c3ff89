"""Title tables: one row per title variation, ready for blocking and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflink.functions.similarity import sorted_tokens
from shelflink.functions.titles import with_variations


def title_table(titles: DataFrame, *keep: str) -> DataFrame:
    """``(id, title)`` to ``(id, variation, text, sorted, main, *keep)``.

    All pattern work on a title happens here, once per distinct title and before any join. Outer
    explode: every title has a variation, and the plain one would make the optimizer push a
    "not empty" filter, with a second copy of all patterns, below the projection.
    """
    return (
        with_variations(titles)
        .select("id", "main", *keep, F.posexplode_outer("variations").alias("variation", "text"))
        .withColumn("sorted", sorted_tokens(F.col("text")))
    )
