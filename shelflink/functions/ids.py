"""ISBN columns.

``unwrap_formula``, ``normalize_isbn`` and ``clean_listing_id`` take raw text. Everything else
takes the result of ``normalize_isbn``: materialise that as a column first (``with_isbn``) so the
pattern runs once per row instead of once per digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.functions.text import strip, strip_column

# Fixed values.
ISBN_SHAPE = r"^([0-9]{9}[0-9X]|[0-9]{13})\z"
FORMULA = r'="([^"]*)"'
NOT_IDENTIFIER = "[^0-9X]"
BOOKLAND = "978"
PREFIX_LENGTH = 9


def _without_separators(col: Column) -> Column:
    return F.translate(strip_column(col), "- ", "")


def _if_isbn(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, ISBN_SHAPE, 1), F.lit(""))


def unwrap_formula(cell: Column) -> Column:
    """Identifier inside a spreadsheet formula cell ``="..."``, or a plain identifier cell.

    The text inside a formula is returned unchecked; a plain cell must look like an ISBN.
    """
    inner = strip(F.regexp_extract(cell, FORMULA, 1))
    plain = F.regexp_extract(_without_separators(cell), ISBN_SHAPE, 1)
    # One NULLIF around both: inside a branch it would evaluate its patterns twice.
    return F.nullif(F.when(cell.rlike(FORMULA), inner).otherwise(plain), F.lit(""))


def normalize_isbn(isbn: Column) -> Column:
    """Upper-cased identifier without separators, NULL unless it has 10 or 13 characters."""
    return _if_isbn(F.upper(_without_separators(isbn)))


def clean_listing_id(raw: Column) -> Column:
    """Catalogue item id reduced to digits and X (``9780593548448B`` loses its suffix)."""
    return F.regexp_replace(raw, NOT_IDENTIFIER, "")


def _digit(norm: Column, place: int) -> Column:
    return F.ascii(F.substring(norm, place, 1)) - F.lit(48)


def _weighted(norm: Column, places: range, weights: list[int]) -> Column:
    total = F.lit(0)
    for place, weight in zip(places, weights):
        total = total + _digit(norm, place) * F.lit(weight)
    return total


def isbn10_to_isbn13(norm: Column) -> Column:
    """13-digit form of a 10-character identifier; its own check character is not looked at."""
    lead = sum(int(d) * w for d, w in zip(BOOKLAND, (1, 3, 1)))
    total = _weighted(norm, range(1, 10), [3, 1] * 4 + [3]) + F.lit(lead)
    check = F.pmod(F.lit(10) - total % F.lit(10), F.lit(10))
    return F.when(
        F.length(norm) == 10,
        F.concat(F.lit(BOOKLAND), F.substring(norm, 1, 9), check.cast("string")),
    )


def isbn13_to_isbn10(norm: Column) -> Column:
    """10-character form, which only exists for identifiers that begin with 978."""
    total = _weighted(norm, range(4, 13), list(range(10, 1, -1)))
    check = F.pmod(F.lit(11) - total % F.lit(11), F.lit(11))
    return F.when(
        (F.length(norm) == 13) & norm.startswith(BOOKLAND),
        F.concat(
            F.substring(norm, 4, 9),
            F.when(check == 10, F.lit("X")).otherwise(check.cast("string")),
        ),
    )


def is_valid_isbn(norm: Column) -> Column:
    """Checksum test; false for NULL."""
    last = F.when(norm.endswith("X"), F.lit(10)).otherwise(_digit(norm, 10))
    ten = (_weighted(norm, range(1, 10), list(range(10, 1, -1))) + last) % F.lit(11) == 0
    thirteen = _weighted(norm, range(1, 14), [1, 3] * 6 + [1]) % F.lit(10) == 0
    return F.coalesce(
        F.when(F.length(norm) == 10, ten).when(F.length(norm) == 13, thirteen), F.lit(False)
    )


def isbn_variants(norm: Column) -> Column:
    """The identifier itself and its other form, as an array; empty for NULL."""
    return F.array_compact(
        F.array(norm, F.coalesce(isbn10_to_isbn13(norm), isbn13_to_isbn10(norm)))
    )


def same_prefix(left: Column, right: Column) -> Column:
    """True when both identifiers exist and agree in their first nine characters."""
    return F.coalesce(
        F.substring(left, 1, PREFIX_LENGTH) == F.substring(right, 1, PREFIX_LENGTH), F.lit(False)
    )


def with_isbn(df: DataFrame, raw: str, norm: str = "isbn_norm") -> DataFrame:
    """Add the normalised identifier of column ``raw``."""
    return df.withColumn(norm, normalize_isbn(F.col(raw)))


def with_isbn_forms(df: DataFrame, raw: str) -> DataFrame:
    """Add normalised form, both lengths, validity and variants of column ``raw``."""
    norm = F.col("isbn_norm")
    return with_isbn(df, raw).withColumns(
        {
            "isbn13": F.when(F.length(norm) == 13, norm).otherwise(isbn10_to_isbn13(norm)),
            "isbn10": F.when(F.length(norm) == 10, norm).otherwise(isbn13_to_isbn10(norm)),
            "isbn_valid": is_valid_isbn(norm),
            "isbn_variants": isbn_variants(norm),
        }
    )
