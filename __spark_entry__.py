"""

Every query reads the whole given tables, or tables Spark derives from them (``shelflink.sources
.library``: sentences of documents as wanted titles, sentences of web pages as a catalogue, parts
as entries with stored result pages).
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import partial

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import oracles as sql
from shelflink.functions import ids, similarity
from shelflink.functions.titles import with_title_parts, with_variations
from shelflink.operators import listings as pages
from shelflink.operators import blocks, reach, scoring
from shelflink.operators.candidates import block_by_title
from shelflink.operators.exact import exact_matches
from shelflink.operators.lookup import lookup_join
from shelflink.operators.titles import title_table
from shelflink.plans import report
from shelflink.plans.link import closest_matches, link
from shelflink.scratch import scratch_root, written
from shelflink.sources import library
from shelflink.sources.reading_list import entries_of_shelf, read_reading_list, title_authors

# Workers need not have this folder on their path.
for module in (similarity, blocks, scoring):
    cloudpickle.register_pickle_by_value(module)

SMOKE_DIR = "/root/testdata/sf0.001"
_stored: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per session and data folder and shared by the queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = written(build(), name)
    return _stored[key]


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "wanted-books", lambda: library.wanted_books(spark, d))


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "catalogue", lambda: library.sentence_catalogue(spark, d))


def _part_entries(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "wanted-parts", lambda: library.wanted_parts(spark, d))


def _part_listings(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "part-listings", lambda: library.part_listings(spark, d))


def _flat(matches: DataFrame) -> DataFrame:
    return matches.withColumn("bonuses", F.concat_ws(",", "bonuses")).drop("high_price")


def _page_matches(spark: SparkSession, d: str) -> DataFrame:
    return stored(
        spark, d, "page-matches", lambda: link(_part_entries(spark, d), _part_listings(spark, d))
    )


# --- reading list -------------------------------------------------------------------------------


def reading_list_csv(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch_root(spark)}/export-{os.urandom(8).hex()}"
    library.reading_list(spark, d).write.csv(path, header=True, quote='"', escape='"')
    return read_reading_list(spark, path).select(
        *(F.col(c).alias(n) for c, n in (
            ("Title", "title"), ("Author", "author"), ("ISBN", "cell10"), ("ISBN13", "cell13"),
            ("Bookshelves", "shelf"),
        ))
    )


def shelf_entries(spark: SparkSession, d: str, use_isbn: bool) -> DataFrame:
    return entries_of_shelf(library.reading_list(spark, d), "en", "position", use_isbn)


def author_enrich(spark: SparkSession, d: str) -> DataFrame:
    export = library.reading_list(spark, d)
    lookup = title_authors(export, "position").withColumnRenamed("author", "title_author")
    rows = export.select("position", F.col("Title").alias("title"))
    return lookup_join(rows, lookup, "title", F.col("position"), "left").select(
        "position", "title_author"
    )


# --- identifiers --------------------------------------------------------------------------------


def id_unwrap_normalise(spark: SparkSession, d: str) -> DataFrame:
    cells = library.reading_list(spark, d).select(
        "position", F.coalesce("ISBN13", "ISBN").alias("cell")
    )
    return cells.select(
        "position",
        ids.unwrap_formula(F.col("cell")).alias("unwrapped"),
        ids.normalize_isbn(F.col("cell")).alias("normalised"),
        ids.clean_listing_id(F.col("cell")).alias("cleaned"),
    )


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    """Entry identifiers and, as mostly invalid ones, the same with the first digit moved last."""
    wanted = _wanted(spark, d).where(F.col("isbn").isNotNull())
    moved = F.concat(F.substring("isbn", 2, 20), F.substring("isbn", 1, 1))
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("isbn").alias("raw")),
                             F.struct(F.lit(1).alias("k"), moved.alias("raw"))))
    return ids.with_isbn(wanted.select("position", both.alias("c")).select("position", "c.*"), "raw")


def identifier(spark: SparkSession, d: str, column, name: str) -> DataFrame:
    return _normalised(spark, d).select("position", "k", column(F.col("isbn_norm")).alias(name))


def id_variants(spark: SparkSession, d: str) -> DataFrame:
    return identifier(
        spark, d, lambda n: F.concat_ws(",", ids.isbn_variants(n)), "variants"
    )


def id_prefix_agree(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy(F.shiftright("position", library.POSITION_BITS)).orderBy("position")
    pairs = _wanted(spark, d).select("position", "isbn", F.lead("isbn").over(own).alias("next_isbn"))
    pairs = ids.with_isbn(ids.with_isbn(pairs, "isbn", "a"), "next_isbn", "b")
    return pairs.select("position", ids.same_prefix(F.col("a"), F.col("b")).alias("agrees"))


# --- titles -------------------------------------------------------------------------------------


def title_normalise(spark: SparkSession, d: str) -> DataFrame:
    return with_title_parts(_wanted(spark, d)).select("position", "main", "subtitle")


def title_variations(spark: SparkSession, d: str) -> DataFrame:
    return with_variations(_wanted(spark, d)).select(
        "position", F.posexplode_outer("variations").alias("variation", "text")
    )


# --- similarity ---------------------------------------------------------------------------------


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every part title with the title of the next part."""
    part = library.load(spark, d, "part")
    text = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))
    left = part.select(F.col("p_partkey").alias("k"), text.alias("a"))
    right = part.select((F.col("p_partkey") - 1).alias("k"), text.alias("b"))
    return left.join(right, "k").withColumns(
        {"sa": similarity.sorted_tokens(F.col("a")), "sb": similarity.sorted_tokens(F.col("b"))}
    )


def sim_ratio(spark: SparkSession, d: str) -> DataFrame:
    score = similarity.ratio(F.col("a"), F.col("b"))
    return _neighbours(spark, d).select("k", score.alias("ratio"))


def sim_partial(spark: SparkSession, d: str) -> DataFrame:
    score = similarity.partial_ratio(F.col("a"), F.col("b"))
    return _neighbours(spark, d).select("k", score.alias("partial_ratio"))


def sim_token_sort(spark: SparkSession, d: str) -> DataFrame:
    score = similarity.ratio(F.col("sa"), F.col("sb"))
    return _neighbours(spark, d).select("k", score.alias("token_sort_ratio"))


def sim_token_set(spark: SparkSession, d: str) -> DataFrame:
    pairs = similarity.with_token_set_ratio(_neighbours(spark, d), "sa", "sb", "token_set_ratio")
    return pairs.select("k", "token_set_ratio")


def score_floor(spark: SparkSession, d: str) -> DataFrame:
    rules = (("ring", "ring", 92), ("promo", "brand", 60))
    pairs = similarity.with_token_set_ratio(_neighbours(spark, d), "sa", "sb", "score")
    raised = scoring.raise_to_floor(F.col("score"), rules, "a", "b")
    return pairs.select("k", "score", raised.alias("raised"))


# --- joins, scores, decisions -------------------------------------------------------------------


def exact_id_join(spark: SparkSession, d: str) -> DataFrame:
    return exact_matches(_wanted(spark, d), _catalogue(spark, d))


def _title_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def titles(table: DataFrame, key: str) -> DataFrame:
        distinct = table.groupBy("title").agg(F.min(key).alias("id"))
        return title_table(distinct.where(F.col("title").isNotNull()))

    return (
        stored(spark, d, "entry-titles", lambda: titles(_wanted(spark, d), "position")),
        stored(spark, d, "listing-titles", lambda: titles(_catalogue(spark, d), "listing_pos")),
    )


def block_candidates(spark: SparkSession, d: str) -> DataFrame:
    return block_by_title(*_title_tables(spark, d))


def reach_candidates(spark: SparkSession, d: str) -> DataFrame:
    return reach.sharing_titles(*_title_tables(spark, d), scoring.least_base_percent(90))


def near_title_candidates(spark: SparkSession, d: str) -> DataFrame:
    return reach.near_titles(*_title_tables(spark, d))


def near_spellings(spark: SparkSession, d: str) -> DataFrame:
    return reach.near_words(reach.title_words(*_title_tables(spark, d))[2])


def _page_pairs(spark: SparkSession, d: str) -> DataFrame:
    from shelflink.plans.link import _side

    wanted = title_table(_part_entries(spark, d).withColumn("id", F.col("position")))
    offered = title_table(
        _part_listings(spark, d).withColumn("id", F.col("listing_pos")), "query_id"
    )
    return lookup_join(
        _side(offered, "l").withColumnsRenamed({"l_query_id": "query_id", "l_id": "listing_id"}),
        _side(wanted, "q").withColumnRenamed("q_id", "query_id"),
        "query_id",
        F.col("listing_id"),
    )


def pair_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_pairs(_page_pairs(spark, d)).select(
        F.col("query_id").alias("position"),
        F.col("q_variation").cast("long").alias("qv"),
        F.col("listing_id").alias("listing_pos"),
        F.col("l_variation").cast("long").alias("lv"),
        *scoring.WEIGHTS,
        "base_score",
    )


def best_match(spark: SparkSession, d: str) -> DataFrame:
    best = scoring.best_pairs(_page_pairs(spark, d), "query_id")
    return best.select(
        F.col("query_id").alias("position"), F.col("listing_id").alias("listing_pos"), "base_score"
    )


def author_gate(spark: SparkSession, d: str) -> DataFrame:
    listings = _catalogue(spark, d).select("listing_pos", F.col("author").alias("l_author"))
    found = stored(spark, d, "by-id", lambda: exact_id_join(spark, d))
    pairs = lookup_join(found, listings, "listing_pos", F.col("position")).join(
        _wanted(spark, d).select("position", "author"), "position"
    )
    score = F.col("author_score")
    return scoring.with_author_score(pairs, "author", "l_author", "author_score").select(
        "position",
        "author_score",
        scoring.author_agrees(score).alias("agrees"),
        scoring.author_band(score).alias("band"),
    )


def price_flag(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Now $"), F.format_number(F.col("p_retailprice") - 880, 2), F.lit(" each"))
    prices = library.load(spark, d, "part").select("p_partkey", text.alias("price"))
    value = scoring.price_value(F.col("price"))
    return prices.select(
        "p_partkey", value.alias("price_value"), scoring.is_high_price(value).alias("high_price")
    )


def link_by_page(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_page_matches(spark, d))


def link_by_page_with_pair_authors(spark: SparkSession, d: str) -> DataFrame:
    entries = _part_entries(spark, d)
    authors = entries.groupBy("title").agg(F.max_by("author", "position").alias("author"))
    return _flat(link(entries, _part_listings(spark, d), title_authors=authors))


def link_by_page_at_75(spark: SparkSession, d: str) -> DataFrame:
    return _flat(link(_part_entries(spark, d), _part_listings(spark, d), threshold=75))


def closest_by_page(spark: SparkSession, d: str) -> DataFrame:
    return closest_matches(_part_entries(spark, d), _part_listings(spark, d))


def link_parts_by_title(spark: SparkSession, d: str) -> DataFrame:
    return _flat(link(_part_entries(spark, d), _part_listings(spark, d).drop("query_id"), min_overlap=60))


def link_by_title(spark: SparkSession, d: str) -> DataFrame:
    return _flat(link(_wanted(spark, d), _catalogue(spark, d)))


# --- extraction ---------------------------------------------------------------------------------


def extract_links(spark: SparkSession, d: str) -> DataFrame:
    raw = library.spread(library.load(spark, d, "pages").select("page_id", "html"), "page_id")
    return pages.extract_links(raw, library.SHOP, "/").select("page_id", "page_pos", "link")


def links_per_page(spark: SparkSession, d: str) -> DataFrame:
    raw = library.load(spark, d, "pages").select("page_id")
    return pages.count_listings(raw, extract_links(spark, d), "page_id")


def extract_listings(spark: SparkSession, d: str) -> DataFrame:
    return library.part_listings(spark, d).select(
        "query_id", "page_pos", "title", "author", "isbn", "price", "url", "cover_url"
    )


def listings_per_page(spark: SparkSession, d: str) -> DataFrame:
    return pages.count_listings(library.part_pages(spark, d), _part_listings(spark, d), "query_id")


def listing_titles(spark: SparkSession, d: str) -> DataFrame:
    return library.part_listings(spark, d).select("title")


# --- reports ------------------------------------------------------------------------------------


def match_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.summary(_part_entries(spark, d), _page_matches(spark, d))


def report_metadata(spark: SparkSession, d: str) -> DataFrame:
    return report.metadata(_part_entries(spark, d), _page_matches(spark, d), 90).drop("generated_at")


def on_matches(spark: SparkSession, d: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return step(_page_matches(spark, d))


def unmatched_entries(spark: SparkSession, d: str) -> DataFrame:
    return report.unmatched(_part_entries(spark, d), _page_matches(spark, d)).select(
        "position", "title"
    )


def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    return report.markdown_lines(_part_entries(spark, d), _page_matches(spark, d), 90)


def written_report(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Write the report and read it back."""
    path = f"{scratch_root(spark)}/report-{os.urandom(8).hex()}"
    report.write_matches(_page_matches(spark, d), _part_entries(spark, d), path, kind)
    if kind == "text":
        return spark.read.text(path)
    if kind == "csv":
        rows = spark.read.csv(path, header=True, escape='"')
        return rows.toDF("title", "match", "score", "price", "url")
    if kind == "json":
        schema = "wanted_title string, listing_match string, score int, score_pct string, price string, url string, cover_url string"
        return spark.read.schema(schema).json(f"{path}/matches")
    return spark.read.parquet(f"{path}/matches").select("certainty", "position", "score")


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    shelf_sql = "WITH " + sql.WANTED + """ SELECT position, title, author, %s AS isbn
        FROM wanted WHERE shelf = 'en'"""
    normalised = f"""WITH {sql.WANTED},
        raws AS (SELECT position, k, CASE k WHEN 0 THEN isbn ELSE substr(isbn, 2) || isbn[1] END AS raw
          FROM wanted, (VALUES (0), (1)) AS t(k) WHERE isbn IS NOT NULL),
        norms AS (SELECT position, k, {sql.isbn_norm('raw')} AS n FROM raws)"""
    ten = "+".join(
        f"(CASE WHEN n[{i + 1}] = 'X' THEN 10 ELSE n[{i + 1}]::INT END)*{10 - i}" for i in range(10)
    )
    thirteen = "+".join(f"n[{i + 1}]::INT*{1 if i % 2 == 0 else 3}" for i in range(13))
    titled = f"WITH {sql.WANTED},{sql.title_parts('wanted', 'qt')}"
    neighbours = """WITH texts AS (
        SELECT p_partkey AS k, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS t FROM part),
        near AS (SELECT x.k, x.t AS a, y.t AS b FROM texts x JOIN texts y ON y.k = x.k + 1),""" + (
        sql.similarity("near", "sim")
    )
    exact = f"""WITH {sql.WANTED},{sql.CATALOGUE},
        ids AS (SELECT position, {sql.isbn_norm('isbn')} AS n FROM wanted),
        forms AS (SELECT position, unnest({sql.variants('n')}) AS form FROM ids),
        offered AS (SELECT listing_pos, {sql.isbn_norm('isbn')} AS form FROM catalogue),
        found AS (SELECT position, min(listing_pos) AS listing_pos FROM forms JOIN offered USING (form) GROUP BY position)"""
    matches = f"WITH {sql.page_matches()}"
    extracted = "SELECT query_id, page_pos, title, author, isbn, price, url, cover_url FROM listings"
    links = """WITH bare AS (SELECT page_id, regexp_replace(html,
          '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g') AS h FROM pages),
        tags AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<a\\b[^>]*>.*?</a\\s*>')) AS tag,
          generate_subscripts(regexp_extract_all(h, '(?is)<a\\b[^>]*>.*?</a\\s*>'), 1) AS i FROM bare),
        hrefs AS (SELECT page_id, i, regexp_extract(tag, '(?is)^<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"'']*)["'']', 1) AS href FROM tags),
        kept AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS page_pos,
          replace(href, '&amp;', '&') AS href FROM hrefs WHERE contains(href, '/')),
        links AS (SELECT page_id, page_pos, CASE WHEN starts_with(href, '/') THEN 'https://shop.example' || href ELSE href END AS link FROM kept)"""
    totals = """totals AS (SELECT (SELECT count(*) FROM wanted) AS total_searched, (SELECT count(*) FROM matches) AS total_matches)"""
    certainty = """CASE WHEN match_type = 'isbn_exact' OR score = 100 OR (score >= 95 AND contains(match_type, 'author'))
        THEN 'certain' ELSE 'potential' END"""
    text_line = "'Listing: ' || match || ', Wanted: ' || query || ', Match Score: ' || score_pct"
    markdown_row = """'| ' || replace(query, '|', '\\|') || ' | ' || replace(match, '|', '\\|') || ' | ' || score_pct
        || ' | ' || coalesce(price, '') || ' | ' || coalesce('[View](' || url || ')', '') || ' |'"""
    return {
        "reading_list_csv": (
            reading_list_csv,
            f"WITH {sql.READING_LIST} SELECT title, author, cell10, cell13, shelf FROM export",
        ),
        "shelf_filter_project": (partial(shelf_entries, use_isbn=True), shelf_sql.replace("%s AS", "isbn AS")),
        "shelf_without_isbn": (
            partial(shelf_entries, use_isbn=False), shelf_sql.replace("%s AS", "NULL::VARCHAR AS"),
        ),
        "author_enrich": (
            author_enrich,
            f"""WITH {sql.READING_LIST}, lookup AS (SELECT title, max(position) AS p FROM export GROUP BY title),
            named AS (SELECT l.title, e.author FROM lookup l JOIN export e ON e.position = l.p)
            SELECT e.position, n.author AS title_author FROM export e JOIN named n ON n.title = e.title""",
        ),
        "id_unwrap_normalise": (
            id_unwrap_normalise,
            f"""WITH {sql.READING_LIST}, cells AS (SELECT position, coalesce(cell13, cell10) AS cell FROM export)
            SELECT position, {sql.unwrap('cell')} AS unwrapped, {sql.isbn_norm('cell')} AS normalised,
              regexp_replace(cell, '[^0-9X]', '', 'g') AS cleaned FROM cells""",
        ),
        "id_10_to_13": (
            partial(identifier, column=ids.isbn10_to_isbn13, name="isbn13"),
            f"""{normalised} SELECT position, k, CASE WHEN length(n) = 10
              THEN {sql.check13('substr(n, 1, 9)')} END AS isbn13 FROM norms""",
        ),
        "id_13_to_10": (
            partial(identifier, column=ids.isbn13_to_isbn10, name="isbn10"),
            f"""{normalised} SELECT position, k, CASE WHEN length(n) = 13 AND n LIKE '978%'
              THEN {sql.check10('substr(n, 4, 9)')} END AS isbn10 FROM norms""",
        ),
        "id_validate": (
            partial(identifier, column=ids.is_valid_isbn, name="valid"),
            f"""{normalised} SELECT position, k, coalesce(CASE WHEN length(n) = 10 THEN ({ten}) % 11 = 0
              WHEN length(n) = 13 THEN ({thirteen}) % 10 = 0 END, false) AS valid FROM norms""",
        ),
        "id_variants": (
            id_variants,
            f"""{normalised} SELECT position, k, array_to_string({sql.variants('n')}, ',') AS variants FROM norms""",
        ),
        "id_prefix_agree": (
            id_prefix_agree,
            f"""WITH {sql.WANTED}, pairs AS (SELECT position, {sql.isbn_norm('isbn')} AS a,
              lead({sql.isbn_norm('isbn')}) OVER (PARTITION BY position >> 32 ORDER BY position) AS b FROM wanted)
            SELECT position, coalesce(substr(a, 1, 9) = substr(b, 1, 9), false) AS agrees FROM pairs""",
        ),
        "title_normalise": (title_normalise, f"{titled} SELECT position, main, subtitle FROM qt"),
        "title_variations": (
            title_variations,
            f"""{titled} SELECT position, (i - 1)::INT AS variation, variations[i] AS text
            FROM qt, unnest(range(1, len(variations) + 1)) AS u(i)""",
        ),
        **{
            f"sim_{short}": (query, f"{neighbours} SELECT k, {column} FROM sim")
            for short, query, column in (
                ("ratio", sim_ratio, "ratio"),
                ("partial", sim_partial, "partial_ratio"),
                ("token_sort", sim_token_sort, "token_sort_ratio"),
                ("token_set", sim_token_set, "token_set_ratio"),
            )
        },
        "score_floor": (
            score_floor,
            f"""{neighbours} SELECT k, token_set_ratio AS score, greatest(token_set_ratio,
              CASE WHEN contains(a, 'ring') AND contains(b, 'ring') THEN 92 ELSE 0 END,
              CASE WHEN contains(a, 'promo') AND contains(b, 'brand') THEN 60 ELSE 0 END) AS raised FROM sim""",
        ),
        "exact_id_join": (exact_id_join, f"{exact} SELECT position, listing_pos FROM found"),
        "block_candidates": (block_candidates, sql.BLOCKS),
        "reach_candidates": (reach_candidates, sql.REACH),
        "near_title_candidates": (near_title_candidates, sql.NEAR),
        "near_spellings": (near_spellings, sql.SPELLINGS),
        "pair_score": (
            pair_score,
            f"""WITH {sql.page_pairs()} SELECT position, qv, listing_pos, lv, ratio, partial_ratio,
              token_sort_ratio, token_set_ratio, base_score FROM scored""",
        ),
        "best_match": (
            best_match,
            f"WITH {sql.page_pairs()},{sql.BEST} SELECT position, listing_pos, base_score FROM best",
        ),
        "author_gate": (
            author_gate,
            f"""{exact}, met AS (SELECT f.position, w.author, c.author AS l_author FROM found f
              JOIN wanted w USING (position) JOIN catalogue c ON c.listing_pos = f.listing_pos),
            {sql.token_set_only('met', 'judged', 'author', 'l_author', 'author_score')}
            SELECT position, author_score, coalesce(author_score >= 50, true) AS agrees,
              CASE WHEN author_score >= 95 THEN 'exact' WHEN author_score > 80 THEN 'boost'
                WHEN author_score < 40 THEN 'penalise' WHEN author_score < 50 THEN 'mismatch'
                WHEN author_score IS NOT NULL THEN 'neutral' END AS band FROM judged""",
        ),
        "price_flag": (
            price_flag,
            """SELECT p_partkey, round(p_retailprice - 880, 2) AS price_value,
              round(p_retailprice - 880, 2) > 50 AS high_price FROM part""",
        ),
        "link_by_page": (link_by_page, f"{matches} SELECT * FROM matches"),
        "link_by_page_with_pair_authors": (
            link_by_page_with_pair_authors,
            f"WITH {sql.page_matches(author_scores_pairs=True)} SELECT * FROM matches",
        ),
        "link_by_page_at_75": (
            link_by_page_at_75, f"WITH {sql.page_matches(threshold=75)} SELECT * FROM matches",
        ),
        "closest_by_page": (
            closest_by_page,
            f"""{matches} SELECT w.position, w.title AS query,
              b.l_title || CASE WHEN b.l_author IS NOT NULL THEN ' by ' || b.l_author
                WHEN base_score IS NULL THEN ' by Unknown' ELSE '' END AS closest,
              CASE WHEN b.position IS NULL THEN 0 ELSE coalesce(s2, 100) END AS score,
              CASE WHEN b.position IS NULL THEN 'no_candidate' WHEN coalesce(s2, 100) < 90 THEN 'below_threshold'
                WHEN base_score IS NOT NULL AND author_score / 100.0::DOUBLE < 0.5 THEN 'author_mismatch'
                ELSE 'accepted' END AS reason
              FROM wanted w LEFT JOIN second_bonus b USING (position)""",
        ),
        "link_parts_by_title": (
            link_parts_by_title, f"WITH {sql.page_matches(by_title=True)} SELECT * FROM matches",
        ),
        # Whole sentences of any length: too slow in SQL; see tests/test_link.py for brute force.
        "link_by_title": (link_by_title, None),
        "extract_links": (extract_links, f"{links} SELECT page_id, page_pos, link FROM links"),
        "links_per_page": (
            links_per_page,
            f"""{links} SELECT p.page_id, count(l.page_id) AS listings FROM pages p
              LEFT JOIN links l USING (page_id) GROUP BY p.page_id""",
        ),
        "extract_listings": (extract_listings, f"WITH {sql.PARTS} {extracted}"),
        "listings_per_page": (
            listings_per_page,
            f"""WITH {sql.PARTS} SELECT p_partkey AS query_id, count(query_id) AS listings FROM part
              LEFT JOIN listings ON query_id = p_partkey GROUP BY p_partkey""",
        ),
        "listing_titles": (listing_titles, f"WITH {sql.PARTS} SELECT title FROM listings"),
        "match_summary": (
            match_summary,
            f"""{matches},{totals} SELECT total_searched, total_matches,
              CASE WHEN total_searched = 0 THEN 0.0 ELSE total_matches::DOUBLE / total_searched * 100 END AS match_rate,
              CASE WHEN total_matches * 100 >= total_searched * 50 THEN 'good'
                WHEN total_matches * 100 >= total_searched * 25 THEN 'fair' ELSE 'poor' END AS rate_band FROM totals""",
        ),
        "report_metadata": (
            report_metadata,
            f"{matches},{totals} SELECT *, 90 AS threshold, 'shelflink' AS tool FROM totals",
        ),
        "certainty_split": (
            partial(on_matches, step=report.certainty_counts),
            f"{matches} SELECT {certainty} AS certainty, count(*) AS matches FROM matches GROUP BY 1",
        ),
        "score_tiers": (
            partial(on_matches, step=report.tier_counts),
            f"""{matches} SELECT CASE WHEN score >= 95 THEN '>=95' WHEN score >= 90 THEN '>=90'
              WHEN score >= 85 THEN '>=85' ELSE 'below' END AS tier, count(*) AS matches FROM matches GROUP BY 1""",
        ),
        "matches_in_order": (
            partial(on_matches, step=lambda m: report.ordered(_flat(m))),
            f"{matches} SELECT * EXCLUDE (position) FROM matches ORDER BY position",
        ),
        "review_filter": (
            partial(
                on_matches,
                step=lambda m: report.review(m, "Ring", 95, "score", True).select("position", "score"),
            ),
            f"""{matches} SELECT position, score FROM matches WHERE score >= 95
              AND (contains(lower(query), 'ring') OR contains(lower(match), 'ring'))""",
        ),
        "unmatched_entries": (
            unmatched_entries,
            f"{matches} SELECT position, title FROM wanted WHERE position NOT IN (SELECT position FROM matches)",
        ),
        "render_text": (
            partial(on_matches, step=report.text_lines),
            f"{matches} SELECT 1 AS place, position, {text_line} AS value FROM matches",
        ),
        "render_markdown": (
            markdown_report,
            f"""{matches},{totals}, head AS (SELECT unnest(['# Listing Matches', '', 'Found **' || total_matches || '** matches out of **'
              || total_searched || '** books (threshold: 90%).', '', '| Wanted Title | Listing Match | Score | Price | Link |', '|---|---|---|---|---|']) AS value,
              unnest(range(6)) AS position FROM totals)
            SELECT 0 AS place, position, value FROM head UNION ALL
            SELECT 1, position, {markdown_row} FROM matches""",
        ),
        "report_text": (
            partial(written_report, kind="text"), f"{matches} SELECT {text_line} AS value FROM matches",
        ),
        "report_csv": (
            partial(written_report, kind="csv"),
            f"{matches} SELECT query AS title, match, score_pct AS score, price, url FROM matches",
        ),
        "report_json": (
            partial(written_report, kind="json"),
            f"""{matches} SELECT query AS wanted_title, match AS listing_match, score, score_pct, price,
              url, cover_url FROM matches""",
        ),
        "report_tables": (
            partial(written_report, kind="tables"),
            f"{matches} SELECT {certainty} AS certainty, position, score FROM matches",
        ),
    }


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: link every wanted title to the catalogue of page sentences."""
    return link_by_title(spark, SMOKE_DIR)


def _corpus_queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Queries of the training-data subpackage, none where it is not installed."""
    try:
        from shelflink.llm import queries as corpus
    except ModuleNotFoundError as missing:
        if missing.name not in ("shelflink.llm", "corpus_pipeline"):
            raise
        return {}
    return corpus.registered()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in (_queries() | _corpus_queries()).items()}


def oracle_sql() -> dict[str, str]:
    both = _queries() | _corpus_queries()
    return {name: text for name, (_, text) in both.items() if text is not None}
