"""Reading-list exports and title-to-author lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflink.functions.ids import unwrap_formula
from shelflink.functions.text import blank_to_null

REQUIRED = ("Title", "Bookshelves")
OPTIONAL = ("Author", "ISBN", "ISBN13")


def read_reading_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Export rows as text columns; other columns are never parsed.

    ``multi_line=False`` lets Spark split large files when no cell holds a line break.
    """
    raw = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"'
    )
    missing = [name for name in REQUIRED if name not in raw.columns]
    if missing:
        raise ValueError(f"reading list lacks {', '.join(missing)}")
    return raw.select(
        *REQUIRED,
        *(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in OPTIONAL),
    )


def entries_of_shelf(
    reading_list: DataFrame,
    shelf: str | Column,
    position: str | None = None,
    use_isbn: bool = True,
) -> DataFrame:
    """Entries ``(position, title, author, isbn)`` whose shelf list *equals* ``shelf``.

    The 13-digit identifier wins over the 10-digit one. ``position`` names a unique key column;
    without one, rows are numbered in file order with gaps.
    """
    shelf = F.lit(shelf) if isinstance(shelf, str) else shelf
    isbn = F.coalesce(unwrap_formula(F.col("ISBN13")), unwrap_formula(F.col("ISBN")))
    key = F.col(position) if position else F.monotonically_increasing_id()
    return reading_list.where(F.col("Bookshelves") == shelf).select(
        key.alias("position"),
        blank_to_null(F.col("Title")).alias("title"),
        blank_to_null(F.col("Author")).alias("author"),
        (isbn if use_isbn else F.lit(None).cast("string")).alias("isbn"),
    )


def title_authors(reading_list: DataFrame, position: str) -> DataFrame:
    """Author per title, trimmed as in ``entries_of_shelf``; the last row of a repeated title wins.

    A title whose last row has no author, or a blank one, has none.
    """
    last = F.max_by(F.struct(blank_to_null(F.col("Author")).alias("author")), F.col(position))
    return (
        reading_list.groupBy(blank_to_null(F.col("Title")).alias("title"))
        .agg(last["author"].alias("author"))
        .where(F.col("title").isNotNull() & F.col("author").isNotNull())
    )
