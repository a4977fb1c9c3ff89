from __future__ import annotations

from pyspark.sql import functions as F

from shelflink.functions import html
from shelflink.operators.listings import count_listings, extract_links, extract_listings

SHOP = "shop.example"
FULL = (
    '<a class="tile" href="/book/dune-messiah/herbert-frank/9780593548448B">'
    '<div data-cnstrc-item-id="9780593548448B" data-cnstrc-item-name="Dune Messiah">'
    '<img src="/c.jpg" alt="Dune Messiah"></div><p class="price">$9.99</p></a>'
)
PAGES = [
    FULL,
    "<a href='/book/x/solo/1'><img alt=' Only &amp; Alt ' src='https://cdn.example/x.jpg'> now $12.99!</a>",
    '<a href="/book/a/b-c/1"><p class="price">$1</p></a>',
    '<a href="https://other.example/book/t/jean-luc-picard/2"><div data-cnstrc-item-name="Cut" '
    'data-cnstrc-item-id="04-394X"></div><span class="the Price">call us</span> $3.5 or $4</a>',
    '<img alt="Canada flag"><img alt="First"><img alt="Second"><img alt="First"><img src="n.png">',
    "",
    '<A HREF="/Book/no">n</A><a href="/other">x</a>',
    "<!-- " + FULL + " --><script>var a='" + FULL + "'</script>" + FULL + "\n" + FULL.replace("9.99", "8"),
    '<a href=/book/q/w-e/3><img alt="" src="/s.png"><div class="big-price" data-k=">"><div><b>Was</b> '
    '<i>$7</i></div> now\n<u> $5 </u></div><p>$1</p></a>',
    '<a href="/book/q/w-e/3"><div data-cnstrc-item-name="N"></div><div data-cnstrc-item-id="1" '
    'data-cnstrc-item-name="Nested"></div><div class="big-price"><div><b>Was</b> '
    '<i>$7</i></div> now\n<u> $5 </u></div><p>$1</p></a>',
]


def pages(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "page_id int, html string")


def test_listings(spark):
    rows = extract_listings(pages(spark), SHOP).orderBy("page_id", "page_pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.page_id, []).append(
            (r.page_pos, r.title, r.author, r.isbn, r.price, r.url, r.cover_url)
        )
    full = (
        "Dune Messiah",
        "Frank Herbert",
        "9780593548448",
        "$9.99",
        "https://shop.example/book/dune-messiah/herbert-frank/9780593548448B",
        "https://shop.example/c.jpg",
    )
    assert got[0] == [(0, *full)]
    assert got[1] == [
        (0, "Only & Alt", None, None, "$12.99", "https://shop.example/book/x/solo/1", "https://cdn.example/x.jpg")
    ]
    assert 2 not in got and 5 not in got and 6 not in got
    assert got[3] == [
        (0, "Cut", "Picard Luc Jean", "04394X", "$3.5", "https://other.example/book/t/jean-luc-picard/2", None)
    ]
    assert [r[1] for r in got[4]] == ["First", "Second"]
    assert got[7] == [(0, *full), (1, *full[:3], "$8", *full[4:])]
    assert 8 not in got
    assert got[9][0][1:5] == ("Nested", "E W", "1", "Was$7now$5")


def test_counts_and_links(spark):
    source = pages(spark)
    counts = count_listings(source, extract_listings(source, SHOP), "page_id")
    assert dict(map(tuple, counts.collect())) == {
        0: 1, 1: 1, 2: 0, 3: 1, 4: 2, 5: 0, 6: 0, 7: 2, 8: 0, 9: 1,
    }
    links = extract_links(source, SHOP, "/other").collect()
    assert [(r.page_id, r.page_pos, r.link) for r in links] == [
        (3, 0, "https://other.example/book/t/jean-luc-picard/2"), (6, 0, "https://shop.example/other")
    ]


def test_entities(spark):
    cases = {
        "a &amp; b": "a & b",
        "&amp;lt;": "&lt;",
        "&lt;&#60;&#x3C;": "<<<",
        "&#233;&#x1F600;&#38;amp;": "é😀&amp;",
        "&unknown; & plain": "&unknown; & plain",
        "&#55296;": "�",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = rows.orderBy("i").select(html.unescape(F.col("t"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_attributes_are_read_as_wholes_and_anchors_end_where_the_next_starts(spark):
    rows = [
        """<a title=it's href="/book/a/x-y/1"><img alt="One"></a>""",
        """<a title="see href=/x" href="/book/a/x-y/2"><img title="no alt = here" alt="Two"></a>""",
        """<a href="/book/a/x-y/3"><img alt="Three"><a href="/book/a/x-y/4"><img alt="Four"></a></a>""",
        """<a data-href="/book/no" href='/book/a/"q"/5' href="/second"><img alt="Five"></a>""",
        """<a href = /book/a/x-y/6><img alt=Six></a>""",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id int, html string")
    got = extract_listings(df, SHOP).orderBy("page_id", "page_pos").select("page_id", "url", "title").collect()
    host = f"https://{SHOP}/book/a"
    assert [tuple(r) for r in got] == [
        (0, f"{host}/x-y/1", "One"), (1, f"{host}/x-y/2", "Two"), (2, f"{host}/x-y/3", "Three"),
        (2, f"{host}/x-y/4", "Four"), (3, f'{host}/"q"/5', "Five"), (4, f"{host}/x-y/6", "Six"),
    ]
