"""Summaries of matches and the files they are written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CERTAIN_SCORE = 95
TIERS = (95, 90, 85)
RATE_BANDS = (50, 25)
NO_MATCHES = "No matches found."
FORMATS = ("text", "csv", "json", "markdown", "tables")


def ordered(matches: DataFrame) -> DataFrame:
    """Rows in the order of the reading list, without the position column."""
    return matches.orderBy("position").drop("position")


def review(
    matches: DataFrame, text: str | None = None, least_score: int = 0, sort_by: str = "position",
    descending: bool = False,
) -> DataFrame:
    """Matches with ``text`` in query or match (any case) and at least ``least_score``, sorted."""
    rows = matches.where(F.col("score") >= least_score)
    if text is not None:
        found = [F.contains(F.lower(c), F.lit(text.lower())) for c in ("query", "match")]
        rows = rows.where(found[0] | found[1])
    key = F.desc(sort_by) if descending else F.asc(sort_by)
    return rows.orderBy(key, "position")


def unmatched(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Entries without an accepted listing."""
    return entries.join(matches.select("position"), "position", "left_anti")


def certainty(score: Column, match_type: Column) -> Column:
    """``certain`` for identifier matches, full scores and author-checked high scores."""
    certain = (
        (match_type == "isbn_exact")
        | (score == 100)
        | ((score >= CERTAIN_SCORE) & F.contains(match_type, F.lit("author")))
    )
    return F.when(certain, "certain").otherwise("potential")


def score_tier(score: Column) -> Column:
    """``>=95``, ``>=90``, ``>=85`` or ``below``."""
    tier = None
    for bound in TIERS:
        step = f">={bound}"
        tier = F.when(score >= bound, step) if tier is None else tier.when(score >= bound, step)
    return tier.otherwise("below")


def with_certainty(matches: DataFrame) -> DataFrame:
    return matches.withColumn("certainty", certainty(F.col("score"), F.col("match_type")))


def certainty_counts(matches: DataFrame) -> DataFrame:
    return with_certainty(matches).groupBy("certainty").agg(F.count("*").alias("matches"))


def tier_counts(matches: DataFrame) -> DataFrame:
    return (
        matches.select(score_tier(F.col("score")).alias("tier"))
        .groupBy("tier")
        .agg(F.count("*").alias("matches"))
    )


def summary(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: searched, matched, match rate in percent and its band."""
    flagged = entries.select(F.lit(1).alias("searched"), F.lit(0).alias("matched")).union(
        matches.select(F.lit(0), F.lit(1))
    )
    good, fair = RATE_BANDS
    rate = F.col("match_rate")
    return (
        flagged.agg(
            F.coalesce(F.sum("searched"), F.lit(0)).alias("total_searched"),
            F.coalesce(F.sum("matched"), F.lit(0)).alias("total_matches"),
        )
        .withColumn(
            "match_rate",
            F.coalesce(
                F.try_divide(F.col("total_matches"), F.col("total_searched")) * 100, F.lit(0.0)
            ),
        )
        .withColumn(
            "rate_band",
            F.when(rate >= good, "good").when(rate >= fair, "fair").otherwise("poor"),
        )
    )


def metadata(
    entries: DataFrame, matches: DataFrame, threshold: int, tool: str = "shelflink"
) -> DataFrame:
    """One row that describes a run."""
    return summary(entries, matches).select(
        "total_searched",
        "total_matches",
        F.lit(threshold).alias("threshold"),
        F.current_timestamp().alias("generated_at"),
        F.lit(tool).alias("tool"),
    )


def text_line(source: str = "Wanted", target: str = "Listing") -> Column:
    return F.concat(
        F.lit(f"{target}: "), F.coalesce("match", F.lit("")), F.lit(f", {source}: "), F.coalesce("query", F.lit("")),
        F.lit(", Match Score: "), F.coalesce("score_pct", F.lit("")),
    )


def markdown_row() -> Column:
    def cell(name: str) -> Column:
        return F.replace(F.coalesce(name, F.lit("")), F.lit("|"), F.lit("\\|"))

    link = F.when(F.col("url").isNotNull(), F.concat(F.lit("[View]("), "url", F.lit(")")))
    cells = [
        cell("query"),
        cell("match"),
        F.col("score_pct"),
        F.coalesce("price", F.lit("")),
        F.coalesce(link, F.lit("")),
    ]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _numbered(line: Column, place: int, position: Column) -> list[Column]:
    return [F.lit(place).alias("place"), position.alias("position"), line.alias("value")]


def text_lines(matches: DataFrame, source: str = "Wanted", target: str = "Listing") -> DataFrame:
    """``(place, position, value)``: one line per match, or the note that there is none."""
    rows = matches.select(*_numbered(text_line(source, target), 1, F.col("position")))
    note = (
        matches.agg(F.count("*").alias("n"))
        .where(F.col("n") == 0)
        .select(*_numbered(F.lit(NO_MATCHES), 0, F.lit(0).cast("long")))
    )
    return rows.unionByName(note)


def markdown_lines(
    entries: DataFrame,
    matches: DataFrame,
    threshold: int,
    source: str = "Wanted",
    target: str = "Listing",
) -> DataFrame:
    """``(place, position, value)``: heading, summary sentence and table."""
    counts = summary(entries, matches)
    n, total = F.col("total_matches"), F.col("total_searched")
    sentence = F.format_string(
        f"Found **%d** matches out of **%d** books (threshold: {threshold}%%).", n, total
    )
    head = F.when(
        n > 0,
        F.array(
            F.lit(f"# {target} Matches"), F.lit(""), sentence, F.lit(""),
            F.lit(f"| {source} Title | {target} Match | Score | Price | Link |"),
            F.lit("|---|---|---|---|---|"),
        ),
    ).otherwise(
        F.array(
            F.lit(f"# {target} Matches"), F.lit(""), sentence, F.lit(""), F.lit(f"_{NO_MATCHES}_")
        )
    )
    heading = counts.select(F.posexplode(head).alias("line", "value")).select(
        *_numbered(F.col("value"), 0, F.col("line").cast("long"))
    )
    return heading.unionByName(
        matches.select(*_numbered(markdown_row(), 1, F.col("position")))
    )


def csv_rows(matches: DataFrame, source: str = "Wanted", target: str = "Listing") -> DataFrame:
    """Five report columns, or a note row when there is no match."""
    titles = [f"{source} Title", f"{target} Match", "Score", "Price", "URL"]
    rows = matches.select("position", *(
        F.col(c).alias(t) for c, t in zip(("query", "match", "score_pct", "price", "url"), titles)
    ))
    note = (
        matches.agg(F.count("*").alias("n"))
        .where(F.col("n") == 0)
        .select(
            F.lit(0).cast("long").alias("position"),
            F.lit(NO_MATCHES.rstrip(".")).alias(titles[0]),
            *(F.lit(None).cast("string").alias(t) for t in titles[1:]),
        )
    )
    return rows.unionByName(note)


def json_rows(matches: DataFrame, source: str = "wanted", target: str = "listing") -> DataFrame:
    """Report fields; NULL ones are left out by the JSON writer."""
    return matches.select(
        "position",
        F.col("query").alias(f"{source}_title"),
        F.col("match").alias(f"{target}_match"),
        "score", "score_pct", "price", "url", "cover_url",
    )


def write_matches(
    matches: DataFrame,
    entries: DataFrame,
    path: str,
    format: str,
    threshold: int = 90,
    source: str = "Wanted",
    target: str = "Listing",
    mode: str = "errorifexists",
) -> None:
    """Write a report directory in input order. ``matches`` should be a stored table.

    ``text``, ``csv``, ``markdown``: part files in order; ``json``: JSON lines under ``matches`` and
    one row under ``metadata``; ``tables``: parquet partitioned by certainty, plus ``metadata``.
    """
    kind = format.lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown format {format!r}; choose one of {', '.join(FORMATS)}")
    if kind == "text":
        lines = text_lines(matches, source, target)
        lines.orderBy("place", "position").select("value").write.mode(mode).text(path)
    elif kind == "markdown":
        lines = markdown_lines(entries, matches, threshold, source, target)
        lines.orderBy("place", "position").select("value").write.mode(mode).text(path)
    elif kind == "csv":
        rows = csv_rows(matches, source, target)
        if matches.isEmpty():
            # The note needs titles and score only.
            rows = rows.select("position", *rows.columns[1:4])
        ordered(rows).write.mode(mode).csv(path, header=True, escape='"')
    else:
        about = metadata(entries, matches, threshold)
        if kind == "json":
            rows = ordered(json_rows(matches, source.lower(), target.lower()))
            rows.write.mode(mode).json(f"{path}/matches")
            about.write.mode(mode).json(f"{path}/metadata")
        else:
            rows = with_certainty(matches).hint("rebalance", "certainty")
            rows.write.mode(mode).partitionBy("certainty").parquet(f"{path}/matches")
            about.write.mode(mode).parquet(f"{path}/metadata")
