"""Matches by identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflink.functions.ids import isbn_variants, normalize_isbn
from shelflink.operators.lookup import lookup_join
from shelflink.scratch import written


def _titled(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("title").isNotNull()) if "title" in listings.columns else listings


def exact_matches(entries: DataFrame, listings: DataFrame, **skew: int) -> DataFrame:
    """``(position, listing_pos)`` of the first listing whose identifier is one of the entry's.

    The catalogue is reduced to its first listing per identifier before it meets the entries, so
    neither a popular entry nor a popular listing multiplies rows. Identifiers are normalised and put
    into their other form once per distinct cell, and entries move once, with the result of their
    cell. Listings without title are no listings.
    """
    listings = _titled(listings)
    wanted = entries.select("position", "isbn").where(F.col("isbn").isNotNull())
    cells = written(wanted.groupBy("isbn").agg(F.count("*").alias("n")), "entry-cells")
    forms = (
        cells.select("isbn", normalize_isbn(F.col("isbn")).alias("_norm"))
        .select("isbn", F.explode_outer(isbn_variants(F.col("_norm"))).alias("identifier"))
        .where(F.col("identifier").isNotNull())
    )
    offered = listings.where(F.col("isbn").isNotNull()).groupBy("isbn").agg(F.min("listing_pos").alias("listing_pos"))
    first = (
        offered.select(normalize_isbn(F.col("isbn")).alias("identifier"), "listing_pos")
        .where(F.col("identifier").isNotNull())
        .groupBy("identifier")
        .agg(F.min("listing_pos").alias("listing_pos"))
    )
    # A form is one of many cells at most by blanks and hyphens; AQE looks after such a skew.
    found = forms.join(first, "identifier").groupBy("isbn").agg(F.min("listing_pos").alias("listing_pos"))
    found = written(found, "found-cells")
    # Only cells with a listing meet the entries again.
    counts = cells.join(found.select("isbn"), "isbn")
    met = lookup_join(wanted, found, "isbn", F.col("position"), counts=counts, **skew)
    return met.groupBy("position").agg(F.min("listing_pos").alias("listing_pos"))


def exact_matches_on_page(entries: DataFrame, listings: DataFrame, **skew: int) -> DataFrame:
    """The same when every entry only meets the listings of its own result page."""
    listings = _titled(listings)
    offered = listings.select(
        F.col("query_id").alias("position"),
        "listing_pos",
        normalize_isbn(F.col("isbn")).alias("identifier"),
    ).where(F.col("identifier").isNotNull())
    wanted = entries.select("position", normalize_isbn(F.col("isbn")).alias("_norm")).select(
        "position", isbn_variants(F.col("_norm")).alias("_variants")
    )
    met = lookup_join(offered, wanted, "position", F.col("listing_pos"), **skew)
    return (
        met.where(F.array_contains("_variants", F.col("identifier")))
        .groupBy("position")
        .agg(F.min("listing_pos").alias("listing_pos"))
    )
