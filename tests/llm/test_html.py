from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelflink.llm.html_text import extract_text, main_text

P = "<p>A longer paragraph, with commas, and a full stop. It says one thing, then another; and ends.</p>"
T = "A longer paragraph, with commas, and a full stop. It says one thing, then another; and ends."
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us, all of us</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 Some Company, all rights reserved. Every one of them.</footer>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<body>{MENU}<article><h1>Title</h1>{P}<p>Short.</p>{P}</article>{FOOT}</body>", f"Title\n{T}\nShort.\n{T}"),
        (f"<body>{MENU}<div id=main><h1>Title</h1>{P}{P}</div><div class='ad'>{P}</div>{FOOT}</body>", f"Title\n{T}\n{T}"),
        (f"<body><header>Site name</header>{MENU}<main>{P}<p>A &amp; B &lt;c&gt; &#233;\n\n x</p></main><aside>{P}</aside>{FOOT}", f"{T}\nA & B <c> é x"),
        (f"<article>{P}<script>var t='</p>';</script><style>p{{}}</style><!-- {P} -->{P}</article>", f"{T}\n{T}"),
        (f"<article><p><b>Open bold, here.<br>and on<br><p>Next one, is it not.{P}", f"Open bold, here. and on\nNext one, is it not.\n{T}"),
        (f"<article>{P}<section class='comments'>{P}{P}{P}</section></article>", T),
        (f"<article>{P}<form><input name=q><p>Search this, now.</p></form>{P}</article>", f"{T}\n{T}"),
        (f"<article>{P}<ul><li>first, point.</li><li>second</ul>{P}</article>", f"{T}\nfirst, point.\nsecond\n{T}"),
        ("<p>only 1 < 2 text, here.", "only 1 < 2 text, here."),
        (f"<div><p class=\"a>b\">{T}</p></div>", T),
        ("plain text, no markup", "plain text, no markup"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_pages(spark):
    long = f"<article>{P * 3000}</article>"
    rows = [(1, "u", long), (2, None, None), (None, "u", "<p>x, y.</p>"), (1, "u", long), (3, "u", "<" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract_text(pages).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_chars for r in got) == sorted([0, 5, 3000 * (len(T) + 1) - 1, 3000 * (len(T) + 1) - 1, 5000])
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(pages.limit(0)).count() == 0
