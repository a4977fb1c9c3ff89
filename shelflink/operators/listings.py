"""Listings out of stored result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.functions import html
from shelflink.functions.ids import clean_listing_id
from shelflink.functions.text import strip

# Fixed values.
PRODUCT_LINK = "/book/"
ITEM_ID = "data-cnstrc-item-id"
ITEM_NAME = "data-cnstrc-item-name"
PRICE_CLASSES = ("price", "Price")
PRICE_TEXT = r"\$\d+\.?\d{0,2}"
NOT_A_COVER = "flag"
SLUG_PARTS = 5


def absolute_url(link: Column, domain: Column) -> Column:
    """Put the shop's address before links that begin with a slash."""
    return F.when(
        F.startswith(link, F.lit("/")), F.concat(F.lit("https://"), domain, link)
    ).otherwise(link)


def author_of_url(url: Column) -> Column:
    """``.../herbert-frank/978...`` to ``Frank Herbert``; NULL when the slug has no hyphen."""
    parts = F.split(url, "/")
    slug = F.try_element_at(parts, F.lit(-2))
    names = F.transform(
        F.reverse(F.split(slug, "-")),
        lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30))),
    )
    usable = (F.size(parts) >= SLUG_PARTS) & F.contains(slug, F.lit("-"))
    return F.when(usable, F.array_join(names, " "))


def product_links(pages: DataFrame, link_part: str) -> DataFrame:
    """One row per link whose address holds ``link_part``: page columns, position, tag, inner HTML.

    A page without such a link keeps one row, with its distinct image titles in ``_titles``.
    """
    anchors = F.filter(
        html.elements(F.col("_html"), "a"),
        lambda a: F.contains(html.attribute(html.opening_tag(a), "href"), F.lit(link_part)),
    )
    image_titles = F.array_distinct(
        F.filter(
            F.transform(
                html.tags_with(F.col("_html"), "img", "alt"), lambda t: html.attribute(t, "alt")
            ),
            lambda alt: ~F.contains(F.lower(alt), F.lit(NOT_A_COVER)),
        )
    )
    body = F.substring(F.col("_anchor"), F.length("_tag") + 1, F.length("_anchor"))
    return (
        pages.withColumn("_html", html.without_hidden(F.col("html")))
        .drop("html")
        .withColumn("_anchors", anchors)
        .withColumn("_titles", F.when(F.size("_anchors") == 0, image_titles))
        .drop("_html")
        .select("*", F.posexplode_outer("_anchors").alias("page_pos", "_anchor"))
        .drop("_anchors")
        .withColumn("_tag", html.opening_tag(F.col("_anchor")))
        .withColumn("_inner", F.regexp_replace(body, r"(?is)</a\s*>\z", ""))
        .drop("_anchor")
    )


def extract_links(pages: DataFrame, domain: str | Column, link_part: str) -> DataFrame:
    """Page columns, link position and absolute address of every matching link."""
    domain = F.lit(domain) if isinstance(domain, str) else domain
    href = html.attribute(F.col("_tag"), "href")
    return (
        product_links(pages, link_part)
        .where(F.col("page_pos").isNotNull())
        .withColumn("link", absolute_url(href, domain))
        .drop("_titles", "_tag", "_inner")
    )


def _with_price(links: DataFrame) -> DataFrame:
    """Add ``price``: text of the first element of a price class, else a price in the text.

    In steps, so that every pattern runs once per link.
    """
    inner = F.col("_inner")
    steps = []
    for i, part in enumerate(PRICE_CLASSES):
        opened, name, text = (f"_{step}{i}" for step in ("opened", "name", "text"))
        links = links.withColumn(opened, F.regexp_extract(inner, html.with_class(part), 0))
        links = links.withColumn(name, F.lower(F.regexp_extract(opened, r"^<([\w-]+)", 1)))
        content = html.inner_of(inner, F.col(opened), F.col(name))
        links = links.withColumn(text, html.tight_text_of(content))
        steps += [opened, name, text]
    by_class = [F.when(F.contains(p, F.lit("$")), p) for p in map(F.col, steps[2::3])]
    by_text = F.nullif(F.regexp_extract(html.text_of(inner), PRICE_TEXT, 0), F.lit(""))
    return links.withColumn("price", F.coalesce(*by_class, by_text)).drop(*steps)


def _first_tag(inner: Column, tag: str, attribute: str) -> Column:
    return F.try_element_at(html.tags_with(inner, tag, attribute), F.lit(1))


def extract_listings(
    pages: DataFrame, domain: str | Column, link_part: str = PRODUCT_LINK
) -> DataFrame:
    """``pages(html, ...)`` to listings: the other page columns plus ``page_pos, title, author,
    isbn, price, url, cover_url``.

    Listings without a title drop; a page without a product link yields its image titles.
    """
    domain = F.lit(domain) if isinstance(domain, str) else domain
    page_columns = [c for c in pages.columns if c != "html"]
    fields = ("page_pos", "title", "author", "isbn", "price", "url", "cover_url")
    inner = F.col("_inner")
    links = (
        _with_price(product_links(pages, link_part))
        .withColumns(
            {
                "_item": _first_tag(inner, r"\w+", ITEM_ID),
                "_alt": _first_tag(inner, "img", "alt"),
                "_src": _first_tag(inner, "img", "src"),
                "url": absolute_url(html.attribute(F.col("_tag"), "href"), domain),
            }
        )
        .withColumns(
            {
                "title": F.coalesce(
                    F.nullif(html.attribute(F.col("_item"), ITEM_NAME), F.lit("")),
                    F.nullif(strip(html.attribute(F.col("_alt"), "alt")), F.lit("")),
                ),
                "isbn": F.nullif(
                    clean_listing_id(html.attribute(F.col("_item"), ITEM_ID)), F.lit("")
                ),
                "author": author_of_url(F.col("url")),
                "cover_url": absolute_url(html.attribute(F.col("_src"), "src"), domain),
            }
        )
    )
    image_only = F.transform(
        "_titles",
        lambda title, i: F.struct(
            i.alias("page_pos"),
            title.alias("title"),
            *(F.lit(None).cast("string").alias(c) for c in fields[2:]),
        ),
    )
    found = F.when(F.col("page_pos").isNull(), image_only).when(
        F.col("title").isNotNull(), F.array(F.struct(*fields))
    )
    return links.select(*page_columns, F.inline_outer(found)).where(F.col("title").isNotNull())


def count_listings(pages: DataFrame, listings: DataFrame, page_key: str) -> DataFrame:
    """Kept listings per page, pages without any included."""
    counts = listings.groupBy(page_key).agg(F.count("*").alias("listings"))
    return (
        pages.select(page_key)
        .join(counts, page_key, "left")
        .select(page_key, F.coalesce("listings", F.lit(0)).alias("listings"))
    )
