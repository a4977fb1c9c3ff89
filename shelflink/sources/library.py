"""A reading list and catalogues derived from stored documents, web pages and parts.

``wanted_books``: every sentence of every document is a wanted title, dressed up the way exports
write titles (article, series, volume, edition, subtitle), with authors and ISBNs.
``sentence_catalogue``: every sentence of every web page is a listing.
``wanted_parts`` and ``part_pages``: every part as an entry, and its result page with links.

Authors and ISBNs follow from the text, so copies of a sentence carry the same identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflink.functions.html import without_hidden
from shelflink.functions.ids import isbn10_to_isbn13, isbn13_to_isbn10
from shelflink.functions.text import without_edges
from shelflink.operators.listings import extract_listings
from shelflink.sources.reading_list import entries_of_shelf

SENTENCE_END = "[.!?\n]+"
EDGES = "^[ \t\r]+|[ \t\r]+$"
NAMES = ("Ada Berg", "Ilya Moreau", "Quentin Zhou", "Tove Lindqvist", "Umar Kapoor")
SHOP = "shop.example"
POSITION_BITS = 32


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores when a table comes as fewer splits than there are cores.

    A table of many files, as on a cluster, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _sentences(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, n, sentence)`` for every non-empty sentence of the whole text."""
    return (
        rows.withColumn("_text", text)
        .select("*", F.posexplode_outer(F.split("_text", SENTENCE_END)).alias("n", "sentence"))
        .withColumn("sentence", without_edges(F.col("sentence"), " \t\r", EDGES))
        .where(F.col("sentence") != "")
        .withColumn("position", F.shiftleft(key, POSITION_BITS) + F.col("n"))
        .drop("_text", "n")
    )


def _hash_number(text: Column) -> Column:
    return F.conv(F.left(F.md5(text), F.lit(7)), 16, 10).cast("long")


def with_isbns(rows: DataFrame) -> DataFrame:
    """Add ``_isbn10`` and ``_isbn13``: six digits from the first word, three from the sentence.

    ``_number`` is the hash of the sentence, computed once.
    """
    first = F.substring_index("sentence", " ", 1)
    nine = F.concat(
        F.lpad((_hash_number(first) % 1_000_000).cast("string"), 6, "0"),
        F.lpad((F.col("_number") % 1000).cast("string"), 3, "0"),
    )
    # The 13-digit form and back gives the check character of the short one.
    return (
        rows.withColumn("_number", _hash_number(F.col("sentence")))
        .withColumn("_nine", nine)
        .withColumn("_isbn13", isbn10_to_isbn13(F.concat("_nine", F.lit("0"))))
        .withColumn("_isbn10", isbn13_to_isbn10(F.col("_isbn13")))
    )


def _name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), (number % len(NAMES) + 1).cast("int"))


def reading_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export-shaped rows: ``position, Title, Author, ISBN, ISBN13, Bookshelves``."""
    docs = spread(
        load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id"
    )
    rows = with_isbns(_sentences(docs, "doc_id", F.col("text")))
    s, source = F.col("sentence"), F.col("source")
    length = F.length(s)
    dressed = (
        F.when(source == "src1", F.concat(F.lit("The "), s))
        .when(source == "src2", F.concat(s, F.lit(" (Harbour Series)")))
        .when(source == "src3", F.concat(s, F.lit(" (Harbour, Book 2)")))
        .when(source == "src4", F.concat(s, F.lit(" (Harbour #3)")))
        .when(source == "src5", F.concat(s, F.lit(" (Volume 4)")))
        .when(source == "src6", F.concat(s, F.lit(" 2nd Edition")))
        .when(source == "src7", F.concat(s, F.lit(": A Novel")))
        .when(source == "src8", F.concat(s, F.lit(": Notes From the Long Coast")))
        .when(source == "src9", F.concat(s, F.lit(" (Revised Edition)")))
        .otherwise(s)
    )
    known = F.col("_number") % 8 < 5
    as_formula = source.isin("src0", "src1", "src2", "src3", "src4")
    thirteen = F.col("_isbn13")
    quoted = F.when(as_formula, F.concat(F.lit('="'), thirteen, F.lit('"'))).otherwise(thirteen)
    return rows.select(
        "position",
        dressed.alias("Title"),
        F.when(length % 7 != 0, _name(length)).alias("Author"),
        F.when(known & (source == "src10"), F.col("_isbn10")).alias("ISBN"),
        F.when(known & (source != "src10"), quoted).alias("ISBN13"),
        F.col("lang").alias("Bookshelves"),
    )


def wanted_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(position, title, author, isbn)`` of every shelf."""
    return entries_of_shelf(
        reading_list(spark, sf_dir), shelf=F.col("Bookshelves"), position="position"
    )


def sentence_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(listing_pos, title, author, isbn, price, url, cover_url)`` from all page text."""
    pages = spread(load(spark, sf_dir, "pages"), "page_id")
    text = F.regexp_replace(without_hidden(F.col("html")), "<[^>]*>", "\n")
    rows = with_isbns(_sentences(pages, "page_id", text))
    s = F.col("sentence")
    length = F.length(s)
    other = (F.col("page_id") % 4 == 0).cast("int")
    number = F.col("_number")
    cents = number % 7000
    return rows.select(
        F.col("position").alias("listing_pos"),
        s.alias("title"),
        F.when(length % 11 != 0, _name(length + other)).alias("author"),
        F.when(number % 8 < 3, F.col("_isbn10"))
        .when(number % 8 == 6, F.col("_isbn13"))
        .alias("isbn"),
        F.concat(
            F.lit("$"), F.floor(cents / 100), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
        ).alias("price"),
        F.col("url"),
        F.lit(None).cast("string").alias("cover_url"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a title, a number and both ISBN forms."""
    part = spread(load(spark, sf_dir, "part"), "p_partkey")
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" "))
    return (
        part.withColumn("_title", F.concat_ws(" ", "p_name", F.lower("p_type"), brand))
        .withColumn("_nine", F.lpad((F.col("p_partkey") * 7).cast("string"), 9, "0"))
        .withColumn("_isbn13", isbn10_to_isbn13(F.concat("_nine", F.lit("0"))))
        .withColumn("_isbn10", isbn13_to_isbn10(F.col("_isbn13")))
    )


def wanted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(position, title, author, isbn)``: every part as an entry of a reading list."""
    kind, title = F.col("p_type"), F.col("_title")
    dressed = (
        F.when(kind == "ECONOMY", F.concat(F.lit("The "), title))
        .when(kind == "SMALL", F.concat(title, F.lit(" (Workshop Series)")))
        .when(kind == "LARGE", F.concat(title, F.lit(": A Handbook for the Curious")))
        .when(kind == "MEDIUM", F.concat(title, F.lit(" 3rd edition")))
        .when(kind == "STANDARD", F.concat(F.initcap("p_name"), F.lit(" (Volume 2)")))
        .otherwise(title)
    )
    size = F.col("p_size")
    return _parts(spark, sf_dir).select(
        F.col("p_partkey").alias("position"),
        dressed.alias("title"),
        F.when(size % 6 != 0, _name(size)).alias("author"),
        F.when(size < 10, F.col("_isbn13")).when(size < 25, F.col("_isbn10")).alias("isbn"),
    )


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, html)``: the stored result page of every part.

    A page links the part itself and the two parts before it, written in the different ways
    listing pages come in. Parts of type PROMO have a page with images only.
    """
    title, size = F.col("_title"), F.col("p_size")
    names = F.split(_name(size), " ")
    slug = F.lower(F.concat_ws("-", F.element_at(names, 2), F.element_at(names, 1)))
    slug = F.when(size % 8 == 0, F.lit("various")).otherwise(slug)
    price = F.format_string("$%.2f", F.col("p_retailprice") - 880)
    alt = F.concat(F.lit('<img src="/covers/'), "p_partkey", F.lit('.jpg" alt="'), title, F.lit('">'))
    data = F.concat(
        F.lit('<div data-cnstrc-item-id="'), "_isbn10", F.lit('B" data-cnstrc-item-name="'), title,
        F.lit('">'), alt, F.lit("</div>"),
    )
    priced = (
        F.when(size < 20, F.concat(F.lit('<p class="item-price">'), price, F.lit("</p>")))
        .when(size < 35, F.concat(F.lit('<p class="Price"><b>Now</b> '), price, F.lit("</p>")))
        .otherwise(F.concat(F.lit("<span>only "), price, F.lit(" today</span>")))
    )
    anchor = F.concat(
        F.lit('<a href="'), F.when(size % 9 == 0, f"https://{SHOP}").otherwise(F.lit("")), F.lit("/book/"),
        F.replace(title, F.lit(" "), F.lit("-")), F.lit("/"), slug, F.lit("/"), "_isbn10",
        F.lit('B">'), F.when(size % 10 == 0, alt).otherwise(data), priced, F.lit("</a>"),
    )
    images = F.concat(
        F.lit('<img src="/f.png" alt="Canada Flag">'), alt, alt,
        F.lit('<img src="/x.png" alt="Second hand copy">'),
    )
    linked = (
        _parts(spark, sf_dir)
        .withColumn("_anchor", anchor)
        .withColumn("_images", images)
        .select(
            "p_partkey",
            F.when(F.col("p_type") == "PROMO", F.col("_images")).alias("_images"),
            "_anchor",
            F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("place"),
        )
    )
    # Three rows at most per page; the page's own part brings the kind of page.
    pages = (
        linked.withColumn("query_id", F.col("p_partkey") + F.col("place"))
        .groupBy("query_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "_anchor"))).alias("_anchors"),
            F.max(F.when(F.col("place") == 0, F.col("_images"))).alias("_images"),
            F.min("place").alias("_first"),
        )
        .where(F.col("_first") == 0)
    )
    body = F.array_join(F.transform("_anchors", lambda a: a["_anchor"]), "\n")
    return pages.select(
        "query_id",
        F.concat(
            F.lit("<html><body><!-- results -->"), F.coalesce("_images", body), F.lit("</body></html>")
        ).alias("html"),
    )


def part_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings extracted from ``part_pages``, with ``listing_pos`` over all pages."""
    return extract_listings(part_pages(spark, sf_dir), SHOP).select(
        (F.shiftleft("query_id", 8) + F.col("page_pos")).alias("listing_pos"), "*"
    )
