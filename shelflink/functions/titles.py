"""Title normalisation: main title, subtitle and search variations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.functions.text import strip

# What is removed from a lower-cased title, in this order, by marker. A title without
# the marker cannot hold the pattern, so the patterns are not tried on it.
# Applied with (?U), Unicode classes, and (?d), only \n ends a line, so .* spans everything else.
LEADING_ARTICLE = r"^(the|a|an)\s+"
NOISE = {
    "(": [
        r"\s*\(.*series.*\)",
        r"\s*\(.*book\s+\d+.*\)",
        r"\s*\(.*#\d+.*\)",
        r"\s*\(volume\s+\d+\)",
        r"\s*\(vol\.\s*\d+\)",
        r"\s*\(\d+\)",
        r"\s*\(.*edition.*\)",
    ],
    "edition": [r"\s*\d+(st|nd|rd|th)\s+edition"],
}
PUNCTUATION = r"""['":;,.\[\]()]+"""
SUBTITLE_MARK = ":"
SHORT_SUBTITLE_WORDS = 3


def _remove(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"(?idU){pattern}", "")


def strip_noise(df: DataFrame, title: str, out: str) -> DataFrame:
    """Add ``out``: lower-cased title without article, series, volume and edition marks."""
    df = df.withColumn(out, _remove(F.lower(title), LEADING_ARTICLE))
    for marker, patterns in NOISE.items():
        text = F.col(out)
        for pattern in patterns:
            text = _remove(text, pattern)
        marked = F.contains(F.col(out), F.lit(marker))
        df = df.withColumn(out, F.when(marked, text).otherwise(F.col(out)))
    return df


def tidy(text: Column) -> Column:
    """Drop punctuation and squeeze white space."""
    squeezed = F.regexp_replace(F.regexp_replace(text, PUNCTUATION, ""), r"(?U)\s+", " ")
    return F.trim(squeezed)


def with_title_parts(df: DataFrame, title: str = "title") -> DataFrame:
    """Add ``main`` (tidied) and ``subtitle`` (as it stands after the first colon, or '')."""
    base = F.col("_base")
    split_at = F.instr(base, SUBTITLE_MARK)
    before = F.substring_index(base, SUBTITLE_MARK, 1)
    after = F.substring(base, split_at + F.lit(1), F.length(base))
    return (
        strip_noise(df, title, "_base")
        .withColumn("main", tidy(F.when(split_at > 0, strip(before)).otherwise(base)))
        .withColumn("subtitle", F.when(split_at > 0, strip(after)).otherwise(F.lit("")))
        .drop("_base")
    )


def with_variations(df: DataFrame, title: str = "title") -> DataFrame:
    """Add ``variations``: main; main + subtitle; main + first words of a long subtitle."""
    has_subtitle = F.col("subtitle") != ""
    words = F.size(F.split("_sub", " "))
    return (
        with_title_parts(df, title)
        .withColumn("_sub", tidy(F.col("subtitle")))
        .withColumn(
            "variations",
            F.array_compact(
                F.array(
                    F.col("main"),
                    F.when(has_subtitle, F.concat_ws(" ", "main", "_sub")),
                    F.when(
                        has_subtitle & (words > SHORT_SUBTITLE_WORDS),
                        F.concat_ws(
                            " ", "main", F.substring_index("_sub", " ", SHORT_SUBTITLE_WORDS)
                        ),
                    ),
                )
            ),
        )
        .drop("_sub")
    )
