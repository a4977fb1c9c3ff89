"""White-space handling shared by the other column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(col: Column) -> Column:
    """Trim Unicode white space on both ends (``trim`` only knows the blank)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def _is_visible(char: Column) -> Column:
    """True where the text begins with a visible ASCII character."""
    return F.ascii(char).between(33, 126)


def strip_column(col: Column) -> Column:
    """``strip`` of a plain column; the pattern only runs where an end is no visible ASCII character."""
    sharp = _is_visible(col) & _is_visible(F.substring(col, -1, 1))
    return F.when(sharp, col).otherwise(strip(col))


def without_edges(col: Column, edges: str, pattern: str) -> Column:
    """``pattern``, which removes the characters ``edges`` at both ends, replaced in a plain column.

    Where a visible ASCII character ends what plain trimming leaves, that is the result.
    """
    trimmed = F.btrim(col, F.lit(edges))
    return F.when(_is_visible(F.substring(trimmed, -1, 1)), trimmed).otherwise(F.regexp_replace(col, pattern, ""))


def blank_to_null(col: Column) -> Column:
    """Missing text is NULL everywhere in this package, never ``''``. ``col`` is a plain column."""
    return F.nullif(strip_column(col), F.lit(""))
