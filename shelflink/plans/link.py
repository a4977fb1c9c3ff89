"""The linking job: entries of a reading list to listings of a catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.functions.ids import normalize_isbn
from shelflink.operators.candidates import block_by_title
from shelflink.operators.exact import exact_matches, exact_matches_on_page
from shelflink.operators.lookup import lookup_join
from shelflink.operators.reach import titles_in_reach
from shelflink.operators.scoring import (
    AUTHOR_LIKE_FACTOR,
    FLOOR_RULES,
    WEIGHTS,
    applies_to_query,
    author_agrees,
    best_pairs,
    best_per_query,
    is_high_price,
    least_base_percent,
    price_value,
    raise_to_floor,
    score_pairs,
    with_author_score,
    with_bonuses,
)
from shelflink.operators.titles import title_table
from shelflink.scratch import written

THRESHOLD = 90
LISTING_FIELDS = ("title", "author", "isbn", "price", "url", "cover_url")


def _side(table: DataFrame, tag: str) -> DataFrame:
    """Title table columns under the names the scoring step expects."""
    return table.select(
        F.col("id").alias(f"{tag}_id"),
        *(F.col(c).alias(f"{tag}_{c}") for c in table.columns if c != "id"),
    )


def _best(pairs: DataFrame, scoring: dict, skew: dict) -> DataFrame:
    if "q_pair_author" in pairs.columns:
        pairs = with_author_score(pairs, "q_pair_author", "l_author", "pair_author_score")
        scoring = {**scoring, "author_score": "pair_author_score"}
    if "need" in scoring:
        # Few pairs are left to score: two more tables would cost more than their windows.
        return best_per_query(score_pairs(pairs, key="query_id", **scoring), "query_id")
    return best_pairs(pairs, "query_id", **scoring, **skew)


def _best_on_page(
    entries: DataFrame, listings: DataFrame, scoring: dict, skew: dict
) -> DataFrame:
    """Entries with ``listing_pos`` and ``base_score``, each against its own result page."""
    by_author = "pair_author" in entries.columns
    wanted = title_table(
        entries.withColumn("id", F.col("position")),
        "named",
        *(["pair_author"] if by_author else []),
    )
    offered = title_table(
        listings.where(F.col("title").isNotNull()).withColumn("id", F.col("listing_pos")),
        "query_id",
        *(["author"] if by_author else []),
    )
    pairs = lookup_join(
        _side(offered, "l").withColumnsRenamed({"l_query_id": "query_id", "l_id": "listing_id"}),
        _side(wanted, "q").withColumnRenamed("q_id", "query_id"),
        "query_id",
        F.col("listing_id"),
        counts=listings.groupBy("query_id").agg(F.count("*").alias("n")),
        **skew,
    )
    best = _best(pairs, scoring, skew).withColumnsRenamed(
        {"query_id": "position", "listing_id": "listing_pos"}
    )
    return entries.join(best, "position")


def _best_by_title(
    entries: DataFrame, listings: DataFrame, scoring: dict, skew: dict, reach: float, min_overlap: int | None
) -> DataFrame:
    """Entries with ``listing_pos`` and ``base_score``, without result pages.

    The base score depends on the two titles only (and on the authors when they take part), and
    among listings with equal texts the first one wins. So both sides shrink to their distinct
    texts, each standing for its first row: a title copied a million times is scored once.
    """
    by_author = "pair_author" in entries.columns
    of_title = ["named", *(["pair_author"] if by_author else [])]
    first_entry = [
        F.min("position").alias("id"),
        F.count("*").alias("n"),
        *(F.max(c).alias(c) for c in of_title),  # one value per title
    ]
    distinct_entries = entries.groupBy("title").agg(*first_entry)
    distinct_listings = (
        listings.where(F.col("title").isNotNull())
        .groupBy("title", *(["author"] if by_author else []))
        .agg(F.min("listing_pos").alias("id"))
    )
    wanted = written(
        title_table(distinct_entries, "title", "n", *of_title), "entry-titles"
    )
    offered = written(
        title_table(distinct_listings, *(["author"] if by_author else [])), "listing-titles"
    )
    if min_overlap is None:
        met = titles_in_reach(wanted, offered, reach / (AUTHOR_LIKE_FACTOR if by_author else 1), scoring["weights"])
    else:
        met = block_by_title(wanted, offered, min_overlap)
    pairs = (
        written(met, "candidates")
        .join(_side(offered, "l").withColumnRenamed("l_id", "listing_id"), "listing_id")
        # Last, so that the pairs of an entry come together.
        .join(_side(wanted.drop("n", "title"), "q").withColumnRenamed("q_id", "query_id"), "query_id")
    )
    titles = wanted.where(F.col("variation") == 0)
    best = (
        _best(pairs, scoring, skew)
        .join(titles.select(F.col("id").alias("query_id"), "title"), "query_id")
        .select("title", "base_score", F.col("listing_id").alias("listing_pos"))
    )
    return lookup_join(
        entries, best, "title", F.col("position"), counts=titles.select("title", "n"), **skew
    )


def _final_scores(matched: DataFrame, floor_rules) -> DataFrame:
    """Bonuses and floors; exact matches (no base score) score 100."""
    is_exact = F.col("base_score").isNull()
    scored = with_bonuses(
        with_author_score(
            matched.withColumns(
                {
                    "q_isbn_norm": normalize_isbn(F.col("isbn")),
                    "l_isbn_norm": normalize_isbn(F.col("l_isbn")),
                }
            ),
            "author",
            "l_author",
            "author_score",
        )
    )
    return scored.withColumns(
        {
            "score": F.when(is_exact, 100).otherwise(
                raise_to_floor(F.col("score"), floor_rules, "title", "l_title")
            ),
            "match_type": F.when(is_exact, "isbn_exact").otherwise(F.col("match_type")),
            "bonuses": F.when(is_exact, F.array().cast("array<string>")).otherwise(
                F.col("bonuses")
            ),
        }
    )


def _named_match() -> Column:
    unknown = F.when(F.col("base_score").isNull(), F.lit("Unknown"))
    by = F.concat(F.lit(" by "), F.coalesce(F.col("l_author"), unknown))
    return F.concat(F.col("l_title"), F.coalesce(by, F.lit(""))).alias("match")


def _author_fits() -> Column:
    return F.col("base_score").isNull() | author_agrees(F.col("author_score"))


def _decide(matched: DataFrame, threshold: int, require_author: bool, floor_rules) -> DataFrame:
    """Rows that pass threshold and author gate, with the columns of a match."""
    accepted = _final_scores(matched, floor_rules).where(F.col("score") >= threshold)
    if require_author:
        accepted = accepted.where(_author_fits())
    return accepted.select(
        "position",
        F.col("title").alias("query"),
        _named_match(),
        "score",
        F.concat(F.col("score"), F.lit("%")).alias("score_pct"),
        F.col("l_price").alias("price"),
        price_value(F.col("l_price")).alias("price_value"),
        F.col("l_url").alias("url"),
        F.col("l_cover_url").alias("cover_url"),
        F.col("l_isbn").alias("isbn"),
        "match_type",
        "bonuses",
        "listing_pos",
    ).withColumn("high_price", is_high_price(F.col("price_value")))


def link(
    entries: DataFrame,
    listings: DataFrame,
    *,
    threshold: int = THRESHOLD,
    require_author: bool = True,
    use_isbn: bool = True,
    weights: Mapping[str, float] = WEIGHTS,
    floor_rules: Sequence[tuple[str, str, int]] = FLOOR_RULES,
    title_authors: DataFrame | None = None,
    min_overlap: int | None = None,
    prune: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """Best accepted listing per entry.

    ``entries(position, title, author, isbn)`` with unique ``position``; ``listings(listing_pos,
    title, author, isbn, price, url, cover_url)`` with unique ``listing_pos``, the order in which
    listings win ties. Missing text is NULL. When ``listings`` has a ``query_id`` column, an entry
    only meets the listings found for it (``query_id`` = ``position``); otherwise candidates are the
    titles in reach of the lowest score that bonuses can lift to the threshold (``operators.reach``), or with
    ``min_overlap`` those that share that much word weight (``operators.candidates``). ``title_authors(title, author)`` lets author similarity weigh in on
    every pair. ``prune`` never changes the result, only its cost. The inputs are read several
    times: pass stored tables, or write derived ones first (``shelflink.scratch.written``).
    """
    matched = _best_listings(
        entries, listings, use_isbn, weights, floor_rules, title_authors, threshold, min_overlap, prune, hot_rows
    )
    return _decide(matched, threshold, require_author, floor_rules)


def closest_matches(
    entries: DataFrame,
    listings: DataFrame,
    *,
    threshold: int = THRESHOLD,
    require_author: bool = True,
    use_isbn: bool = True,
    weights: Mapping[str, float] = WEIGHTS,
    floor_rules: Sequence[tuple[str, str, int]] = FLOOR_RULES,
    title_authors: DataFrame | None = None,
    min_overlap: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """``(position, query, closest, score, reason)``: the best listing of every entry, accepted or not.

    ``reason`` is ``accepted``, ``below_threshold``, ``author_mismatch`` or ``no_candidate`` (no listing
    to compare with; score 0). Arguments as in ``link``; nothing is pruned by the threshold.
    """
    matched = _best_listings(
        entries, listings, use_isbn, weights, floor_rules, title_authors, threshold, min_overlap, False, hot_rows
    )
    fits = _author_fits() if require_author else F.lit(True)
    reason = (
        F.when(F.col("score") < threshold, "below_threshold").when(~fits, "author_mismatch").otherwise("accepted")
    )
    found = _final_scores(matched, floor_rules).select(
        "position", _named_match().alias("closest"), "score", reason.alias("reason")
    )
    return entries.select("position", F.col("title").alias("query")).join(found, "position", "left").select(
        "position", "query", "closest", F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("reason", F.lit("no_candidate")).alias("reason"),
    )


def _best_listings(
    entries: DataFrame,
    listings: DataFrame,
    use_isbn: bool,
    weights: Mapping[str, float],
    floor_rules: Sequence[tuple[str, str, int]],
    title_authors: DataFrame | None,
    threshold: int,
    min_overlap: int | None,
    prune: bool,
    hot_rows: int | None,
) -> DataFrame:
    """Each entry with its best listing: by identifier, else by title, with ``prune`` among pairs that can be accepted."""
    skew = {} if hot_rows is None else {"hot_rows": hot_rows}
    on_page = "query_id" in listings.columns
    entries = entries.select(
        "position", "title", "author", "isbn" if use_isbn else F.lit(None).cast("string").alias("isbn")
    )
    if title_authors is not None:
        # A blank author is no author.
        known = F.nullif(F.trim("author"), F.lit(""))
        lookup = title_authors.select("title", known.alias("pair_author"))
        entries = lookup_join(entries, lookup, "title", F.col("position"), "left", **skew)

    match_by_id = exact_matches_on_page if on_page else exact_matches
    exact = match_by_id(entries, listings, **skew)
    entries = written(entries.join(exact, "position", "left"), "entries")

    untried = entries.where(F.col("listing_pos").isNull() & F.col("title").isNotNull())
    untried = untried.drop("listing_pos").withColumn(
        "named", applies_to_query(floor_rules, "title")
    )
    scoring, need = {"weights": weights}, least_base_percent(threshold)
    if prune:
        scoring |= {"need": need, "keep_all": F.col("q_named")}
    if on_page:
        fuzzy = _best_on_page(untried, listings, scoring, skew)
    else:
        fuzzy = _best_by_title(untried, listings, scoring, skew, need, min_overlap)

    by_id = entries.where(F.col("listing_pos").isNotNull()).withColumn(
        "base_score", F.lit(None).cast("double")
    )
    decided = written(by_id.unionByName(fuzzy.drop("named")).drop("pair_author"), "decided")
    payload = listings.select("listing_pos", *(F.col(c).alias(f"l_{c}") for c in LISTING_FIELDS))
    return lookup_join(decided, payload, "listing_pos", F.col("position"), **skew)
